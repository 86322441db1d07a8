"""Token counts, conversation repair and prefix trie against the library, brute force and each other."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from panelspark.llm import conversation_repair, prefix_trie, token_counts
from panelspark.llm.queries import QUERIES

CONV = "conv_id long, turn long, role string, text string"
EXTRA = [f"'x' AS {c}" for c in ("content", "n_tokens", "kind", "copy", "block", "at", "part", "key", "seq", "turns", "gaps")]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- token counts ----

@pytest.fixture(scope="module")
def files():
    return pytest.importorskip("public_tokenizers").path


ODD = [None, "", " ", "a", "a", "a <|endoftext|> b", "x\t\n  y", "x y", "x  y", "é" * 3000 + " 😀\u0000", "word " * 30_000, "<|STARTOFTEXT|> A", "  　a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(spark, sf, files, name, tmp_path):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    rows = rows[:150 if name != "byte_bpe_50k.json" else None] + [(None if i == 3 else 10_000 + i // 2, t) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", *EXTRA)
    tok = token_counts.load(files(name))
    if name.endswith(".json"):
        from tokenizers import Tokenizer
        library = Tokenizer.from_file(files(name))
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)       # noqa: E731
    else:
        import sentencepiece
        library = sentencepiece.SentencePieceProcessor(model_file=files(name))
        count = lambda t: len(library.encode(t))       # noqa: E731
    out = token_counts.count_tokens(docs, tok, f"file://{tmp_path}/cache").collect()
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 1024) for i, t in rows]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))


def test_only_misses_are_encoded_once(spark, files, tmp_path):
    tok, cache = token_counts.load(files("byte_bpe_50k.json")), f"file://{tmp_path}/cache"

    def texts(*ts):
        return spark.createDataFrame([(hashlib.sha256(t.encode()).digest(), t) for t in ts], "content binary, text string")

    assert token_counts.fill_cache(texts("a", "b b", "a", "a"), tok, cache) == 2
    assert token_counts.fill_cache(texts("a", "b b"), tok, cache) == 0
    assert token_counts.fill_cache(texts("a", "c", "c"), tok, cache) == 1
    token_counts.BROADCAST_ROWS, kept = 0, token_counts.BROADCAST_ROWS
    try:
        assert token_counts.fill_cache(texts("d", "c", "d"), tok, cache) == 1
    finally:
        token_counts.BROADCAST_ROWS = kept
    stored = token_counts.stored_counts(spark, cache, tok.version)
    assert stored.count() == 4 and token_counts.stored_counts(spark, cache, "another version") is None
    # A stored count is what is read: the text itself is not encoded again.
    first = spark.createDataFrame([(hashlib.sha256(b"planted").digest(), 77)], "content binary, n_tokens long")
    for batch in ("x", "y"):           # two runs stored the same digest
        first.write.parquet(f"{cache}/tokenizer={tok.version}/batch={batch}")
    docs = spark.createDataFrame([(1, "planted"), (2, "new"), (3, "planted")], "doc_id long, text string")
    out = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tok, cache, limit=70).collect()}
    assert out == {1: 77, 2: 1, 3: 77}
    assert token_counts.count_tokens(docs.limit(0), tok).collect() == []
    with pytest.raises(ValueError):
        token_counts.load("a.txt")


# ---- repair ----

def damaged(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        out[c] += []
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            out[c] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def by_hand(rows):
    """Row by row, the best of all edits for every role that may be written last."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    turns = [t for t, _, _ in rows if t is not None]
    counts = [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0] + [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    counts.append(sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])))
    def fits(a, b):
        return a + b in ("s", "u", "su", "ua", "au")

    def inserted(best):
        for _ in range(2):
            for last, (cost, audit, left) in list(best.items()):
                for role in ("user", "assistant"):
                    if fits(last, role[0]):
                        new = (cost + 2, audit + "I", left + ((role, ""),))
                        best[role[0]] = min(best.get(role[0], new), new)
        return best

    best = inserted({"": (0, "", ())})
    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for last, (cost, audit, left) in best.items():
            more = cost + (fault == "truncated")
            edits = [(last, (cost + 3, audit + "D", left))]
            if fault not in ("blank", "duplicate"):
                edits += [(r[0], (more + 2, audit + "R", left + ((r, text),))) for r in ("user", "assistant") if fits(last, r[0])]
                if role and fits(last, role[0]):
                    edits.append((role[0], (more, audit + "K", left + ((role, text),))))
            for key, new in edits:
                after[key] = min(after.get(key, new), new)
        best = inserted(after)
    cost, audit, left = min(v for k, v in best.items() if k in ("", "a"))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in left))
    return (*counts, cost, audit, sha("\n".join(f"{r}:{t}" for r, t in left)))


def some_conversations(n, seed, longest=4):
    draw = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Why?\n", "Né", "Yes.", None, "a\x0b", "! "]
    roles = ["system", "user", "assistant", "tool", "user", "assistant", None, ""]
    rows = []
    for c in range(n):
        for k in range(draw.randint(1, longest)):
            rows.append((c if c else None, None if draw.random() < .1 else k + draw.randint(0, 1), draw.choice(roles), draw.choice(texts)))
    return rows


@pytest.mark.parametrize("long", [4096, 2])
def test_repairs_are_the_cheapest(spark, monkeypatch, long):
    monkeypatch.setattr(conversation_repair, "LONG", long)
    rows = some_conversations(60, 1)
    for k in range(1, 5):       # the same roles in a row, a system turn late, nothing but blanks
        rows += [(900 + k, i, ["user", "assistant", "system", "user"][k - 1], f"T{i}.") for i in range(3)]
    rows += [(950, i, "user", " ") for i in range(4)] + [(960, 2, "user", "twice.")] * 3
    frame = spark.createDataFrame(rows, CONV).selectExpr("*", *EXTRA)
    if long == 2:               # blocks of workers see the patched length too
        frame = frame.coalesce(3)
    verdicts, turns = conversation_repair.repair(conversation_repair.damage(frame))
    out = {r.conv_id: tuple(r)[1:] for r in verdicts.collect()}
    want = {c: by_hand(r) for c, r in damaged(rows).items()}
    assert out == want
    texts = defaultdict(list)
    for r in sorted(turns.collect(), key=lambda r: r.position):
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: sha("\n".join(texts[c])) for c in out} == {c: w[-1] for c, w in want.items()}


def test_repair_of_the_whole_table(spark, sf):
    """Every conversation against all edits; audits have an edit per row."""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = {r.conv_id: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf).collect()}
    after = damaged(rows)
    assert set(out) == set(after)
    for c, given in after.items():
        assert out[c] == by_hand(given), c
        counts, cost, audit = out[c][:5], out[c][5], out[c][6]
        assert len(audit) - audit.count("I") == len(given)
        assert 2 * audit.count("R") + 3 * audit.count("D") + 2 * audit.count("I") <= cost


def test_long_conversation_by_blocks_equals_one_piece(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(c, k, draw.choice(["user", "assistant", "user", "assistant", "system"]), draw.choice(["A.", "B", "C?", f"{k}!", f"{k}."]))
            for c in (1, 2) for k in range(300)] + [(3, 0, "user", "Hi."), (3, 1, "assistant", "Ho.")]
    frame = spark.createDataFrame(rows, CONV)
    whole = sorted(map(tuple, conversation_repair.repair(frame)[0].collect()))
    monkeypatch.setattr(conversation_repair, "LONG", 32)
    verdicts, turns = conversation_repair.repair(frame)
    assert sorted(map(tuple, verdicts.collect())) == whole
    assert conversation_repair.repair(frame.limit(0))[0].collect() == []


# ---- trie ----

def trie_by_hand(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()[:32]), (role or "", text or "")))
    own = {c: tuple(x for _, x in sorted(v)) for c, v in own.items()}
    full = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        full[c] = own.get(c - c % 100, ())[:h] + mine[h:]
    members = defaultdict(list)
    for c, t in sorted(full.items()):
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out = []

    def walk(p):
        leaves, saved = (0, 0) if kids[p] else (1, 0)
        for k in kids[p]:
            a, b = walk(k)
            leaves, saved = leaves + a, saved + b
        saved += (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        ends = ",".join(str(c) for c in members[p] if len(full[c]) == len(p))
        out.append((members[p][0], len(p), members[p[:-1]][0] if p else None, len(members[p]), len(kids[p]), leaves, saved, sha(ends)))
        return leaves, saved
    if members:
        walk(())
    return sorted(out, key=str)


def trie_rows(seed, n=400):
    draw = random.Random(seed)
    rows = []
    for c in draw.sample(range(700), n):
        for k in range(draw.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, None if draw.random() < .02 else k, draw.choice(["user", None, "assistant"]), draw.choice(["same", "same", "same", "é😀", None, ""])))
    return rows + [(None, 1, "user", "no conversation"), (100_000, 0, "user", "long " * 20_000)] + [(300_001, 1, "user", "twice")] * 3


@pytest.mark.parametrize("block, seed", [(10_000, 1), (40, 2)])
def test_trie_is_that_of_all_prefixes(spark, monkeypatch, block, seed):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = trie_rows(seed)
    frame = spark.createDataFrame(rows, CONV).selectExpr("*", *EXTRA)
    out = sorted((tuple(r) for r in prefix_trie.conversation_trie(frame).collect()), key=str)
    assert out == trie_by_hand(rows)


def test_trie_of_the_whole_table_and_edges(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = QUERIES["op13_prefix_trie"](spark, sf)
    assert sorted((tuple(r) for r in out.collect()), key=str) == trie_by_hand(rows)
    assert prefix_trie.conversation_trie(spark.createDataFrame([], CONV)).collect() == []
    lonely = spark.createDataFrame([(7, None, None, None)], CONV)       # h of 7 is above its one turn
    assert sorted((tuple(r) for r in prefix_trie.conversation_trie(lonely).collect()), key=str) == trie_by_hand([(7, None, None, None)])


def test_forest_merges_in_descending_depth():
    def seq(s):
        return "".join(s).encode().ljust(0) and b"".join(c.encode() * prefix_trie.WIDTH for c in s)

    words = sorted(["", "ab", "abc", "abd", "b", "bcd"])
    rows = [(seq(w), [1] * len(w), [None] * len(w) + [(1, i, 0, 0, 0, "x")]) for i, w in enumerate(words)]
    nodes = prefix_trie.Forest(rows, True, False).nodes
    assert sorted((n[1], n[0], n[3], n[4]) for n in nodes) == [
        (0, 0, 6, 2), (1, 1, 3, 1), (1, 4, 2, 1), (2, 1, 3, 2), (2, 5, 1, 1), (3, 2, 1, 0), (3, 3, 1, 0), (3, 5, 1, 0)]
    assert prefix_trie.common_prefix(seq("abc"), seq("abd")) == 2 and prefix_trie.common_prefix(b"", seq("a")) == 0
