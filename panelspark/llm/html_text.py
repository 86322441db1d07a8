"""Main text of web pages: a bidirectional LSTM labels every block in the context of its whole page.

A page becomes its sequence of leaf blocks: the text between block-level tags, with the path of open
elements above it. Each block is a vector, the mean of trained vectors of its hashed path tokens (tags,
classes, ids) beside the mean of those of its hashed words. A forward and a backward LSTM (numpy) read the
whole sequence; a logistic output says whether the block belongs to the article.

There are no labelled pages, so the labeller is trained by distant supervision on at most TRAIN_PAGES pages:
blocks whose path names a known part of a page (article, nav, footer, ...) carry that label. Copies of these
pages with typical further parts (comments, forms, side bars, notices) put between their blocks, and with
the telling names of some elements removed, teach it to use position, neighbours and words as well.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

TRAIN_PAGES = 300          # pages of a fit, those with the smallest hashed ids
TRAIN_PAGE_BYTES = 200_000 # longer pages are not used for a fit; those used are read whole
PATHS, WORDS = 1 << 11, 1 << 12
DIM, HIDDEN = 12, 16
EPOCHS, BATCH, RATE = 8, 16, 0.12
_GROUP = 60_000            # padded blocks labelled at once
_CACHE = 300_000

# Fixed values of the format.
RAW = "script|style|iframe|title|textarea"      # without an end tag they last to the end of the page
FOREIGN = ("svg", "math")                        # in these "/>" closes an element
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section "
            "summary table tbody td tfoot th thead tr ul".split())
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th",
                "option": "option"}
# Fixed values of the supervision: names of page parts.
ARTICLE = set("article main post entry story".split())
OTHER = set("nav menu header footer aside sidebar ad ads advert advertisement banner sponsor promo cookie consent notice popup modal "
            "newsletter subscribe form comment comments respond reply related share social breadcrumb breadcrumbs pagination toolbar "
            "widget masthead copyright legal login search".split())
PARTS = ("aside|div.sidebar|section.comments|div.comment|ol.comment-list li.comment|form|form.newsletter|div.cookie-notice|"
         "div#cookie-consent|div.related-posts|div.share|ul.breadcrumb li|div.ad|div.advertisement|header|header.masthead|footer|"
         "div#footer|nav|nav.menu ul li|div.pagination|div.login|div.popup|div.promo|div.banner|div#comments|div.respond").split("|")

# A quote opens a value only after "="; one that is never closed ends at the next ">". Nothing is read twice.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|["'][^>]*+|[^\s>"'][^\s>]*+)?+"""
_TAG = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+(?:>|\Z)|"
                  rf"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>=]++|{_VALUE})*+)(?:>|\Z)|(?P<text>[^<]+|<)", re.S | re.I)
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW.split("|")}
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")


class _Slots(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, token: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        slot = self[token] = xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")) % self.size
        return slot


def leaf_blocks(html: str | None) -> list[tuple[tuple[str, ...], str]]:
    """(path, text) of every block with text, in page order. A path names open elements, with classes and ids."""
    out, stack, names, text = [], [], [], []

    def flush() -> None:
        if text:
            words = _SPACE.sub(" ", unescape("".join(text))).strip(" ")
            text.clear()
            if words:
                out.append((tuple(names), words))

    html = html or ""
    at = 0
    while m := _TAG.match(html, at):
        at = m.end()
        kind = m.lastgroup
        if kind == "text":
            text.append(m["text"])
            continue
        if kind != "attrs":
            continue
        tag = m["tag"].lower()
        if tag in BLOCK:
            flush()
        elif tag == "br":
            text.append(" ")
        if m["end"]:
            if tag in stack:
                k = len(stack) - 1 - stack[::-1].index(tag)
                del stack[k:], names[k:]
            continue
        if tag in VOID or m["attrs"].endswith("/") and (tag in FOREIGN or any(x in stack for x in FOREIGN)):
            continue
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            continue
        for other in SELF_CLOSING.get(tag, "").split():
            for k in range(len(stack) - 1, -1, -1):
                if stack[k] == other:
                    del stack[k:], names[k:]
                elif stack[k] in BLOCK:
                    break
        stack.append(tag)
        attrs = m["attrs"]
        extra = [x for a in _NAMES.findall(attrs) for x in (a[1] or a[2] or a[3]).lower().split()] if "=" in attrs else []
        names.append(" ".join([tag, *extra]))
    flush()
    return out


def _name_parts(path: tuple[str, ...]) -> Iterator[str]:
    for element in path:
        for name in element.split():
            yield from re.split(r"[^a-z0-9]+", name)


def known_label(path: tuple[str, ...]) -> int | None:
    """1 article, 0 another part, None unknown, by the names on the path; the innermost telling one decides."""
    label = None
    for part in _name_parts(path):
        if part in ARTICLE:
            label = 1
        elif part in OTHER:
            label = 0
    return label


class Encoder:
    """Blocks to slots of path tokens and words."""

    def __init__(self):
        self.paths, self.words, self.seen = _Slots(PATHS), _Slots(WORDS), {}

    def path(self, path: tuple[str, ...]) -> list[int]:
        slots = self.seen.get(path)
        if slots is None:
            if len(self.seen) >= _CACHE:
                self.seen.clear()
            leaf = path[-1].split(" ")[0] if path else ""
            tokens = {x for element in path for x in element.split()} | set(_name_parts(path)) | {"leaf:" + leaf}
            slots = self.seen[path] = [self.paths[t] for t in sorted(tokens)]
        return slots

    def page(self, blocks) -> tuple[np.ndarray, ...]:
        """Owners and slots of path tokens, then of words; shapes of a block's text count as words."""
        path_slots, path_owner, word_slots, word_owner = [], [], [], []
        get = self.words.__getitem__
        for k, (path, text) in enumerate(blocks):
            own = self.path(path)
            path_slots += own
            path_owner += [k] * len(own)
            tokens = text.lower().split()
            own = list(map(get, tokens))
            own.append(get(f"\0size:{len(tokens).bit_length()}"))
            own.append(get(f"\0end:{text[-1]}" if text[-1] in ".!?:;" else "\0end"))
            word_slots += own
            word_owner += [k] * len(own)
        return tuple(np.array(x, np.int64) for x in (path_owner, path_slots, word_owner, word_slots))


def _means(table: np.ndarray, owner: np.ndarray, slots: np.ndarray, n: int) -> np.ndarray:
    """Mean of the table's rows per owner; owners ascend and each has a row."""
    count = np.bincount(owner, minlength=n)
    starts = np.concatenate([[0], np.cumsum(count)[:-1]])
    return np.add.reduceat(table[slots], starts, axis=0) / count[:, None]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    tables: list[np.ndarray]     # of path tokens and of words
    cells: list[np.ndarray]      # forward and backward: (2 * DIM + HIDDEN + 1, 4 * HIDDEN)
    out: np.ndarray              # (2 * HIDDEN + 1)


def new_model(seed: int = 11) -> Model:
    r = np.random.default_rng(seed)
    cells = [r.normal(0, 0.25, (2 * DIM + HIDDEN + 1, 4 * HIDDEN)) for _ in range(2)]
    for c in cells:
        c[-1] = 0
        c[-1, HIDDEN:2 * HIDDEN] = 1                                       # open forget gates
    return Model([r.normal(0, 0.5, (PATHS, DIM)), r.normal(0, 0.5, (WORDS, DIM))], cells, r.normal(0, 0.3, 2 * HIDDEN + 1))


def _vectors(model: Model, coded) -> np.ndarray:
    po, ps, wo, ws = coded
    n = int(wo[-1]) + 1
    return np.concatenate([_means(model.tables[0], po, ps, n), _means(model.tables[1], wo, ws, n)], axis=1)


def _run_cell(w: np.ndarray, x: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Hidden states (T, B, H) of a batch x (T, B, 2 * DIM); masked steps pass their state on."""
    steps, size, h = len(x), x.shape[1], HIDDEN
    pre = x @ w[:2 * DIM] + w[-1]
    state, cell = np.zeros((size, h), x.dtype), np.zeros((size, h), x.dtype)
    states, saved, inner = np.empty((steps, size, h), x.dtype), [], w[2 * DIM:-1]
    for t in range(steps):
        z = pre[t] + state @ inner
        gates = _sigmoid(z[:, :3 * h])
        new = np.tanh(z[:, 3 * h:])
        m = mask[t][:, None]
        cell_ = gates[:, h:2 * h] * cell + gates[:, :h] * new
        squashed = np.tanh(cell_)
        state_ = gates[:, 2 * h:] * squashed
        if keep:
            saved.append((gates, new, cell, squashed, state))
        cell, state = np.where(m, cell_, cell), np.where(m, state_, state)
        states[t] = state
    return states, saved


def _back_cell(w, x, mask, saved, d_states):
    """Gradients of a cell's weights and of its inputs."""
    h, steps = HIDDEN, len(x)
    dw, dx = np.zeros_like(w), np.zeros_like(x)
    ds = np.zeros_like(d_states[0])
    dc = np.zeros_like(ds)
    for t in range(steps - 1, -1, -1):
        gates, new, cell, squashed, state = saved[t]
        m = mask[t][:, None]
        ds = ds + d_states[t]
        live, dc_live = ds * m, dc * m
        d_cell = dc_live + live * gates[:, 2 * h:] * (1 - squashed ** 2)
        dz = np.concatenate([d_cell * new, d_cell * cell, live * squashed], axis=1) * gates * (1 - gates)
        dz = np.concatenate([dz, d_cell * gates[:, :h] * (1 - new ** 2)], axis=1)
        dw[:2 * DIM] += x[t].T @ dz
        dw[2 * DIM:-1] += state.T @ dz
        dw[-1] += dz.sum(axis=0)
        dx[t] = dz @ w[:2 * DIM].T
        ds = np.where(m, dz @ w[2 * DIM:-1].T, ds)
        dc = np.where(m, d_cell * gates[:, h:2 * h], dc)
    return dw, dx


def _padded(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in parts)
    x = np.zeros((steps, len(parts), parts[0].shape[1]), parts[0].dtype)
    mask = np.zeros((steps, len(parts)), bool)
    for b, p in enumerate(parts):
        x[:len(p), b], mask[:len(p), b] = p, True
    return x, mask


def label_pages(model: Model, coded: list[tuple]) -> list[np.ndarray]:
    """P(article) of every block of every page; pages of similar length are labelled together."""
    result: list[np.ndarray] = [np.empty(0)] * len(coded)
    order = sorted((k for k in range(len(coded)) if len(coded[k][2])), key=lambda k: int(coded[k][2][-1]))
    while order:
        longest, group = int(coded[order[-1]][2][-1]) + 1, []
        while order and len(group) * longest < _GROUP:
            group.append(order.pop())
        x, mask = _padded([_vectors(model, coded[k]).astype(np.float32) for k in group])
        ahead, _ = _run_cell(model.cells[0].astype(np.float32), x, mask)
        back, _ = _run_cell(model.cells[1].astype(np.float32), x[::-1], mask[::-1])
        score = _sigmoid(ahead @ model.out[:HIDDEN] + back[::-1] @ model.out[HIDDEN:-1] + model.out[-1])
        for b, k in enumerate(group):
            result[k] = score[:int(coded[k][2][-1]) + 1, b]
    return result


def _train_step(model: Model, pages, memory) -> float:
    x, mask = _padded([_vectors(model, c) for c, _ in pages])
    y, known = np.zeros(mask.shape), np.zeros(mask.shape)
    for b, (_, labels) in enumerate(pages):
        for t, label in enumerate(labels):
            if label is not None:
                y[t, b], known[t, b] = label, 1
    ahead, saved_a = _run_cell(model.cells[0], x, mask, True)
    back, saved_b = _run_cell(model.cells[1], x[::-1], mask[::-1], True)
    states = np.concatenate([ahead, back[::-1]], axis=2)
    p = _sigmoid(states @ model.out[:-1] + model.out[-1])
    d = (p - y) * known / max(1, known.sum())
    d_out = np.concatenate([np.tensordot(d, states, axes=([0, 1], [0, 1])), [d.sum()]])
    d_states = d[:, :, None] * model.out[:-1]
    dw_a, dx_a = _back_cell(model.cells[0], x, mask, saved_a, d_states[:, :, :HIDDEN])
    dw_b, dx_b = _back_cell(model.cells[1], x[::-1], mask[::-1], saved_b, d_states[::-1, :, HIDDEN:])
    dx = dx_a + dx_b[::-1]
    d_tables = [np.zeros_like(t) for t in model.tables]
    for b, (coded, _) in enumerate(pages):
        for k, (owner, slots) in enumerate((coded[:2], coded[2:])):
            share = 1 / np.maximum(np.bincount(owner, minlength=len(dx)), 1)
            np.add.at(d_tables[k], slots, dx[owner, b, k * DIM:(k + 1) * DIM] * share[owner][:, None])
    for value, grad, g2 in zip([*model.tables, *model.cells, model.out], [*d_tables, dw_a, dw_b, d_out], memory):
        g2 += grad * grad
        value -= RATE * grad / np.sqrt(g2)
    return float(-(known * np.log(np.maximum(np.where(y > 0, p, 1 - p), 1e-12))).sum() / max(1, known.sum()))


def _varied(blocks, labels, rng, texts):
    """The page with further parts between its blocks, or without the telling names of its article."""
    out = list(zip(blocks, labels))
    top = tuple(blocks[0][0][:2]) if blocks else ()
    for _ in range(int(rng.integers(1, 4))):
        part = tuple(PARTS[int(rng.integers(len(PARTS)))].replace(".", " ").replace("#", " ").split("|"))
        inside = [k for k, (_, label) in enumerate(out) if label == 1]
        deep = bool(inside) and rng.random() < 0.4
        at = int(rng.choice(inside)) + 1 if deep else int(rng.integers(len(out) + 1))
        above = out[at - 1][0][0][:-1] if deep else top
        out[at:at] = [((above + part + (("p",) if rng.random() < 0.6 else ()), texts[int(rng.integers(len(texts)))]), 0)
                      for _ in range(int(rng.integers(1, 5)))]
    if rng.random() < 0.3:
        out = [((tuple("div" if e.split()[0] in ARTICLE else e for e in path), text), label) for (path, text), label in out]
    blocks, labels = zip(*out) if out else ((), ())
    return list(blocks), list(labels)


def fit(pages: list[str | None], seed: int = 11) -> Model:
    """The labeller trained on the pages' own part names and on varied copies. No known part: the untrained model."""
    model, encoder, rng = new_model(seed), Encoder(), np.random.default_rng(seed)
    parsed = [leaf_blocks(p) for p in pages]
    labelled = [(b, [known_label(path) for path, _ in b]) for b in parsed]
    labelled = [(b, y) for b, y in labelled if any(v is not None for v in y)]
    texts = sorted({text for b, y in labelled for (_, text), v in zip(b, y) if v is not None})
    memory = [np.full_like(v, 1e-4) for v in [*model.tables, *model.cells, model.out]]
    for _ in range(EPOCHS if labelled else 0):
        made = []
        for blocks, labels in labelled:
            if rng.random() < 0.6:
                blocks, labels = _varied(blocks, labels, rng, texts)
            made.append((encoder.page(blocks), labels))
        order = rng.permutation(len(made))
        for k in range(0, len(order), BATCH):
            _train_step(model, [made[i] for i in order[k:k + BATCH]], memory)
    return model


def train(pages: DataFrame, limit: int = TRAIN_PAGES, page_bytes: int = TRAIN_PAGE_BYTES) -> Model:
    """The labeller fitted on at most limit pages of at most page_bytes each, so that the driver gets no more than their product.

    The pages with the smallest hashes are taken; equal ones count once. Null and empty pages teach nothing.
    """
    given = pages.select(F.col("html").cast("string").alias("html")).where(f"octet_length(html) between 1 and {int(page_bytes)}")
    given = given.select(F.xxhash64("html").alias("k"), "html")
    last = given.select("k").distinct().orderBy("k").limit(limit).agg(F.max("k")).first()[0]
    if last is None:
        return fit([])
    picked = given.where(F.col("k") <= last).groupBy("k").agg(F.min("html").alias("html")).orderBy("k")
    return fit([r["html"] for r in picked.collect()])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars of every row: the blocks labelled as article, joined by an empty line.

    Defined results: a null or empty html, or one without article blocks, gives an empty text; repeated
    rows give equal texts; an empty table gives an empty table; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder()
        for whole_batch in batches:
            for start in range(0, len(whole_batch), 256):
                batch = whole_batch.slice(start, 256)
                blocks = [leaf_blocks(h.as_py()) for h in batch.column(2)]
                scores = label_pages(model, [encoder.page(b) for b in blocks])
                texts = ["\n\n".join(text for (_, text), p in zip(b, s) if p >= 0.5) for b, s in zip(blocks, scores)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"])

    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
    return given.mapInArrow(run, "page_id long, url string, text string, n_chars long")
