"""Mixing, decontamination, archives, url rules, models, and the pipeline as a whole."""
import base64
import gzip
import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, html_text, minhash, mixing, quality_model, quality_rules, secrets, url_filter, warc
from panelspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_hand(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in names}
        full |= set(over)


def check_mix(rows, sizes):
    want, taken = targets_by_hand(sizes), Counter()
    for source, r in rows:
        assert r.target == pytest.approx(want[source]) and r.source_size == sizes[source] and 0 <= r.taken <= 2 * r.size
        taken[source] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(2 * mixing.BLOCK, 0.02 * want[s]), s


def test_mix_of_the_whole_table(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = Counter()
    for r in docs.values():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    rows = QUERIES["op5_mixing"](spark, sf).collect()
    assert len(rows) == len(docs) and all(r.size == len(WORD.findall(docs[r.doc_id].text or "")) for r in rows)
    check_mix([(docs[r.doc_id].source, r) for r in rows], sizes)
    assert sorted(rows) == sorted(QUERIES["op5_mixing"](spark, sf).collect())


def test_mix_of_odd_rows(spark):
    rows = [(i, "w " * (i % 7 * 50), [None, "b", "é", "a"][i % 4]) for i in range(200)] + [(5, "x", "a")] * 3 + [
        (None, "y y", None), (None, "y y", None), (900, None, "only"), (901, "v " * 30_000, "long"),
        (902, "", "a"), (902, "", "a"), (902, None, "a"), (None, None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    out = mixing.mix(df).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    taken = {r.source_size: r.target for r in out}
    want = targets_by_hand(sizes)
    assert sorted(taken.values()) == pytest.approx(sorted({sizes[s]: want[s] for s in sizes}.values()))
    assert all(r.taken <= 2 * r.size for r in out) and mixing.mix(df.limit(0)).collect() == []


@pytest.mark.parametrize("piece", [4_000, 3])
def test_mixed_blocks_hold_the_words_of_their_documents(spark, monkeypatch, piece):
    monkeypatch.setattr(mixing, "PIECE", piece)         # three documents: most blocks lie in several pieces
    rows = [(i, " \t".join(f"{i}.{k}" for k in range(i * 37 % 700)), [None, "", "a"][i % 3]) for i in range(120)]
    df = spark.createDataFrame(rows + [(7, None, "a"), (8, " ", None)], "doc_id long, text string, source string")
    table = mixing.mixed_blocks(df).collect()
    assert sorted((r.shard, r.slot) for r in table) == [divmod(i, mixing.SHARD_SLOTS) for i in range(len(table))]
    taken, streams = Counter(), defaultdict(dict)
    for r in table:
        words = r.text.split(" ")
        assert streams[r.source].setdefault(r.block, words) == words and sum(p.words for p in r.pieces) == len(words)
        for p in r.pieces:
            assert {w.split(".")[0] for w in words[:p.words]} == {str(p.doc_id)}
            taken[p.doc_id] += p.words
            words = words[p.words:]
    assert {r.doc_id: r.taken for r in mixing.mix(df).collect() if r.size} == {i: taken[i] for i, t, _ in rows if t}
    assert len({(r.source, r.epoch, r.block) for r in table}) == len(table)
    whole = [(s, b) for s, bs in streams.items() for b in bs if b < max(bs)]
    assert all(len(streams[s][b]) == mixing.BLOCK for s, b in whole)
    full = streams[""]                             # a source taken twice over: all its words, in order within a document
    in_order = [w for b in sorted(full) for w in full[b]]
    assert sorted(in_order) == sorted(w for _, t, s in rows if s == "" for w in t.split()) and set(full) == set(range(len(full)))
    for i, t, s in rows:
        if s == "":
            assert [w for w in in_order if w.startswith(f"{i}.")] == t.split()


@pytest.mark.parametrize("n", [1, 2, 3, 257, 1000])
def test_places_are_a_permutation(spark, n):
    df = spark.range(n).select(mixing.place(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("p"))
    got = [r.p for r in df.collect()]
    assert sorted(got) == list(range(n)) and (n < 10 or got != sorted(got))


def test_shards_are_full_and_mixed(spark):
    per = spark.createDataFrame([("a", 300_000, 450_000.0), ("b", 500_000, 250_000.0)], "source string, source_size long, target double")
    plan = mixing.plan_of(per)
    rows = mixing.slots(plan).collect()
    # Every block finds by itself the slots that take it.
    own = plan.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("s", F.explode(mixing.slots_of(F.col("block"))))
    assert sorted((r.source, r.block, r.s.epoch, *divmod(r.s.at, mixing.SHARD_SLOTS)) for r in own.collect()) == sorted(
        (r.source, r.block, r.epoch, r.shard, r.slot) for r in rows)
    shards = defaultdict(Counter)
    for r in rows:
        shards[r.shard][r.source] += 1
    assert len({(r.shard, r.slot) for r in rows}) == len(rows) and all(sum(c.values()) == mixing.SHARD_SLOTS for s, c in shards.items() if s < max(shards))
    assert all(abs(c["a"] / sum(c.values()) - 9 / 14) < 0.08 for c in shards.values() if sum(c.values()) > 900)
    times = Counter((r.source, r.block) for r in rows)
    assert set(times.values()) <= {0, 1, 2} and max(r.epoch for r in rows) == 1


ITEM = ("Maria bought 12 apples and Peter bought 7 pears at the market on Main street, so how many more fruits than pears "
        "did Maria carry 3 km to her house?")


def test_leaks_with_other_parameters(spark, make_docs):
    items = spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (1, ITEM), (None, ITEM)], "item_id long, text string")
    frame = ITEM.replace("12", "40").replace("7", "9").replace("Maria", "Anna").replace("Peter", "John").replace("3 km", "5 km")
    knot = "now that Anna told Bob that Anna owes Bob and Anna likes Bob but Anna left Bob"
    items = items.union(spark.createDataFrame([(4, knot)], items.schema))
    other, broken = knot.replace("Anna", "Carl").replace("Bob", "Dora"), knot
    for name in ("Eve", "Fay", "Gus", "Hal", "Ida", "Joe", "Kim", "Lea"):
        broken = re.sub("Anna|Bob", name, broken, count=1)
    rows = [(1, "Before. " + ITEM + " After."), (2, "q " * 30 + frame.upper().replace("ANNA", "Anna")), (3, "x y. " + frame), (4, "short one"),
            (5, None), (6, ""), (7, " ".join(ITEM.split()[:10])), (8, broken), (10, other), (9, "nothing here at all to see, move along please, thank you"),
            (1, "Before. " + ITEM + " After."), (None, ITEM)]
    out = decontaminate.decontaminate(make_docs(rows), items).collect()
    flagged = sorted((r.doc_id or 0, r.contaminated) for r in out)
    assert [x for x in flagged if x[0] not in (2,)] == [(0, True), (1, True), (1, True), (3, True), (4, False), (5, False), (6, False),
                                                        (7, False), (8, False), (9, False), (10, True)]
    kept = decontaminate.decontaminate_stage(make_docs(rows), items)
    assert kept.columns == make_docs(rows).columns and sorted(r.doc_id for r in kept.collect() if r.doc_id != 2) == [4, 5, 6, 7, 8, 9]
    assert decontaminate.decontaminate(make_docs([]), items).collect() == []
    assert not any(r.contaminated for r in decontaminate.decontaminate(make_docs(rows), items.limit(0)).collect())


def test_a_conflict_costs_only_its_own_windows(spark, make_docs):
    text = ("a farmer has 2 fields and grows wheat on one of them while the other lies bare all through the long winter months "
            "until rain comes back again and then 5 workers plant corn on it with 2 old machines")
    items = spark.createDataFrame([(1, text)], "item_id long, text string")
    shared = ("it takes 1 day and 2 men or 3 more to dig 4 pits", "it takes 7 day and 7 men or 7 more to dig 7 pits")
    items = items.union(spark.createDataFrame([(2, shared[0]), (3, "so 2 and 2 or 2 but 2 if 2 as 2 by 2")], items.schema))
    rows = [(1, text), (2, text.replace("with 2", "with 3")), (3, text.replace("5", "2")), (4, "so 1 and 3 or 4 but 5 if 6 as 7 by 8"),
            (5, shared[1]), (6, text.replace("2", "8").replace("5", "9"))]
    out = decontaminate.decontaminate(make_docs(rows), items).collect()
    assert {r.doc_id: r.item_id for r in out} == {1: 1, 2: 1, 3: 1, 4: None, 5: 2, 6: 1}


def test_leaks_in_other_case(spark, make_docs):
    german = "Der Bauer bringt am Morgen 12 Eier und 3 Liter Milch zum Markt, wo Frau Schmidt alle Eier kauft. Wie viel bleibt dem Bauern?"
    items = spark.createDataFrame([(1, ITEM), (2, german)], "item_id long, text string")
    frame = ITEM.replace("12", "40").replace("7", "9").replace("Maria", "Anna").replace("Peter", "John").replace("3 km", "5 km")
    rows = [(1, ITEM.lower()), (2, "q " * 30 + frame.upper().replace("ANNA", "Anna")), (3, ITEM.upper()), (4, "x. " + german.lower().replace("12", "40")),
            (5, german.upper()), (6, ITEM.title()), (7, "x y. " + frame), (8, " ".join(ITEM.lower().split()[:10])), (9, "der bauer bringt am morgen nichts zum markt")]
    out = decontaminate.decontaminate(make_docs(rows), items).collect()
    assert {r.doc_id: r.item_id for r in out} == {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 1, 7: 1, 8: None, 9: None}
    assert sorted(r.doc_id for r in decontaminate.decontaminate_stage(make_docs(rows), items).collect()) == [8, 9]


def leaks_by_hand(texts, items):
    """{(text, item_id)} by the rules of decontaminate, every text against every item, without hashes."""
    import regex

    flags = regex.V1 | regex.S
    edge = (r"[[\p{P}\p{S}]--[<>]](?<=[\p{L}\p{N}>][\p{P}\p{S}])[[\p{P}\p{S}]--[<>]]*(?=[\x20\x09-\x0D]|$)"
            r"|[[\p{P}\p{S}]--[<>+\-]](?<=(?:^|[\x20\x09-\x0D])[\p{P}\p{S}])[[\p{P}\p{S}]--[<>+\-]]*(?=[\p{L}\p{N}@])")
    unit = r"(?<=<num>|<num>\x20)(?:" + "|".join(sorted(decontaminate.UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"

    def forms(text):
        named = regex.sub(r"\p{Lu}(?<=[^.!?:;\x20\x09-\x0D]\x20\p{Lu})\p{Ll}+", r"\ue000\g<0>", text or "", flags=flags)
        bare = regex.sub(edge.replace("@", "\ue000"), "", named.lower(), flags=flags)
        numbered = regex.sub(unit, "<unit>", regex.sub(r"(?<![\p{L}\p{N}])[+\-]?[0-9]+(?:[.,:/][0-9]+)*", "<num>", bare, flags=flags), flags=flags)
        split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]      # noqa: E731
        out = [split(numbered.replace("\ue000", "")), split(regex.sub(r"\ue000\p{L}+", "<name>", numbered))]
        return split(bare.replace("\ue000", "")), out

    def windows(text, n):
        plain, both = forms(text)
        out = set()
        for words in both:
            for i in range(len(words) - n + 1):
                w = tuple(words[i:i + n])
                loose = 2 * sum("<" in x for x in w) > n
                out.add((i, tuple(plain[i:i + n]) if loose else w, tuple(plain[i:i + n])))
        return out

    found, lengths = set(), {}
    sides = {}
    for item_id, text in set(items):
        if item_id is None or len(forms(text)[0]) < decontaminate.SHORTEST:
            continue
        lengths[item_id] = n = min(8, len(forms(text)[0]))
        index = defaultdict(list)
        for j, w, q in windows(text, n):
            index[w].append((j, q))
        total = len({j for js in index.values() for j, _ in js})
        for t in set(texts):
            key = (t, n)
            if key not in sides:
                sides[key] = windows(t, n)
            runs = defaultdict(list)
            for i, w, p in sides[key]:
                for j, q in index.get(w, []):
                    runs[i - j].append((j, w, p, q))
            held = set()
            for run in runs.values():
                votes = Counter((a, b) for _, w, p, q in run for x, a, b in zip(w, q, p) if "<" in x)
                best = {}
                for (a, b), k in votes.items():
                    best[a] = max(best.get(a, (0, "")), (k, b))
                held |= {j for j, w, p, q in run if p == q or all(best[a][1] == b for x, a, b in zip(w, q, p) if "<" in x)}
            if 100 * len(held) >= 50 * total or len(held) >= 24:
                found.add((t, item_id))
    times = Counter(i for _, i in found)
    return {(t, i) for t, i in found if lengths[i] == 8 or not (times[i] > 10 and times[i] * 1000 > len(set(texts)))}


def check_leaks(spark, rows, items):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS hash", "2 AS item_id", "3 AS _t", "4 AS _gone_t", "5 AS _gone_n", "6 AS at")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS k", "2 AS _size")
    want = leaks_by_hand([t or "" for _, t in rows], items)
    per = defaultdict(set)
    for t, i in want:
        per[t].add(i)
    out = decontaminate.decontaminate(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.n_items, r.item_id or 0) for r in out) == sorted((d or 0, len(per[t or ""]), min(per[t or ""], default=0)) for d, t in rows)
    kept = decontaminate.decontaminate_stage(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == sorted(d or 0 for d, t in rows if not per[t or ""])
    return per


def test_leaks_of_the_whole_table_are_those_by_hand(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    flagged = {r.doc_id: r.n_items for r in QUERIES["op9_decontaminate"](spark, sf).collect()}
    per = Counter(t for t, _ in leaks_by_hand(list(docs.values()), items))
    assert flagged == {d: per[t] for d, t in docs.items()} and sum(map(bool, flagged.values())) > 5


def test_lists_of_numbers_and_names_are_no_leaks(spark):
    names = ["Anna Bob Carl Dora Eve Fay Gus Hal Ida Joe Kim Lea", "Max Ned Ola Pia Rob Sam Tim Una Val Wim Xan Yan"]
    numbers = " ".join(str(1_000_000 + k) for k in range(500))
    prices, scores = ("cost: " + " ".join(f"{k * f}.{k}" for k in range(1, 40)) for f in (3, 7))
    items = [(1, " ".join(str(k) for k in range(50))), (2, "so x " + names[0]), (3, prices), (4, "What is the capital city?"), (5, "Go on now"),
             (6, "see the next page"), (7, ITEM + " It is so. " + " ".join(f"then word{k}" for k in range(80)))]
    rows = [(1, numbers), (2, "so x " + names[1]), (3, scores), (4, "so x " + names[0]), (5, prices), (6, "xx what is the CAPITAL city yy"),
            (7, "Go on now"), (8, ITEM + " It is so."), (9, "q " + " ".join(ITEM.split()[:20])), (10, None), (11, " ".join(str(k) for k in range(60))),
            (12, "4 " * 3000), (12, "4 " * 3000), (None, prices), (13, "a " * 20_000 + "what is the capital city")]
    rows += [(100 + k, f"see the next page {k}") for k in range(12)]
    per = check_leaks(spark, rows, items)
    flagged = {d: sorted(per[t or ""]) for d, t in rows if per[t or ""]}
    assert flagged == {4: [2], 5: [3], None: [3], 6: [4], 8: [7], 11: [1], 13: [4]}


def test_a_long_list_of_numbers_takes_no_longer(spark):
    rows = [(1, " ".join(str(k) for k in range(20_000))), (2, "7 " * 20_000)]
    items = [(1, " ".join(str(k) for k in range(500_000, 500_200))), (2, " ".join(["8"] * 200)), (3, " ".join(str(k) for k in range(900, 1100)))]
    out = decontaminate.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id: r.item_id for r in out.collect()} == {1: 3, 2: None}


def test_leaks_of_random_texts(spark):
    import random
    draw = random.Random(4)
    bits = ["Anna", "Bob", "km", "3", "4.5", "and", "the", "of", "pays", "for", "Then", "said.", "(x)", "12%", "ends", "Über", "so"]
    items = [(i, " ".join(draw.choice(bits) for _ in range(draw.randint(4, 24)))) for i in range(25)]
    swap = {"Anna": "Lea", "Bob": "Tom", "3": "8", "4.5": "7"}
    rows = []
    for d in range(120):
        words = draw.choice(items)[1].split()
        if draw.random() < .5:
            words = [swap.get(w, w) for w in words]
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = draw.choice(bits)
        rows.append((d, " ".join([draw.choice(bits) for _ in range(draw.randint(0, 6))] + words)))
    assert sum(map(bool, check_leaks(spark, rows, items).values())) > 20


def test_archives(spark, tmp_path):
    rows = [(1, "http://a\nb", "x"), (2, None, "x"), (3, "u", None), (None, "n", "x"), (4, "é", "é\r\n\r\nWARC/1.1"), (4, "é", "é\r\n\r\nWARC/1.1"),
            (None, None, "zz"), (7, "big", "<p>" + "long " * 400_000), (8, "", ""), (9, "https://a.example.com/" + "long/" * 60, "y")]
    pages = spark.createDataFrame([(*r, "w") for r in rows], "page_id long, url string, html string, archive string")
    warc.write_archives(pages.coalesce(2), f"file://{tmp_path}/raw")
    done = warc.normalise(spark, f"file://{tmp_path}/raw", f"file://{tmp_path}/members")
    assert sum(r.records for r in done.collect()) == len(rows)
    for i in warc.index(spark, f"file://{tmp_path}/members").collect():
        with open(i.archive.replace("file://", ""), "rb") as f:
            f.seek(i.offset)
            record = gzip.decompress(f.read(i.length))
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    first = {}
    for i, _, h in rows:
        first[h or ""] = max(first.get(h or "", i or -1), i or -1)
    out = warc.read_archives(spark, f"file://{tmp_path}/members").collect()
    want = []
    for i, u, h in rows:
        body, resp = (h or "").encode(), first[h or ""]
        kind = "response" if i == resp or resp < 0 else "revisit"
        want.append((i, u, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, resp if kind == "revisit" else None))
    assert sorted(map(str, (tuple(r) for r in out))) == sorted(map(str, want))
    assert warc.round_trip(pages.limit(0)).collect() == []
    shares = spark.createDataFrame([(i, "u", "same" * (i % 2)) for i in range(50)], "page_id long, url string, html string")
    assert Counter(r.record_type for r in warc.round_trip(shares).collect()) == {"response": 2, "revisit": 48}


def test_split_records_in_small_pieces():
    records = [b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % len(c) + c for c in (b"", b"abc\r\n\r\nWARC/1.1", b"x" * 5000)]
    stream = b"".join(r + b"\r\n\r\n" for r in records)
    for size in (1, 7, 4096):
        assert list(warc.split_records(stream[i:i + size] for i in range(0, len(stream), size))) == records
    with pytest.raises(ValueError):
        list(warc.split_records([stream[:-9]]))


def test_url_index_finds_what_every_rule_finds(spark):
    urls = [None, "", "x", "http://net/", "http://a.net", "HTTP://A.Example.NET/en/x?y", "https://example.net/EN/", "http://example.com/de/1#t",
            "//x.com", "http://casino-win.example.org/en", "http://casinowin.org/", "http://u:p@free.bets.com:80/", "http://notnet/", "://",
            "http://spam.org/fr/", "http://x.net?net/", "http://é.net/é", "http://poker", "http://a/casino", "http://b.org/fr"]
    pages = spark.createDataFrame([(i, u, "t") for i, u in enumerate(urls)] + [(3, urls[3], "t")], "page_id long, url string, token string")
    compiled = {r.pattern: re.compile(r.pattern, re.S) for r in url_filter.RULES}
    for r in url_filter.url_filter(pages).collect():
        host, path = url_filter.split_url(urls[r.page_id])
        assert (r.host, r.path) == (host, path)
        fits = [x for x in url_filter.HOST_RULES if (lambda h, p: (host == h or host.endswith("." + h)) and path.startswith(p))(
            x.name.partition("/")[0], "/" + x.name.partition("/")[2])]
        best = max(fits, key=lambda x: len(x.name), default=None)
        bad = any(compiled[x.pattern].search(host + path) for x in url_filter.WORD_RULES)
        assert r.rule == (best.name if best else None)
        assert r.verdict == (best.verdict if best else "block" if bad else "allow"), urls[r.page_id]
    assert url_filter.url_filter(pages.limit(0)).collect() == []


def test_rules_lie_under_their_rarest_token():
    rules = [url_filter.host_rule("block", "example.net/en/"), url_filter.word_rule("free", "bets")]
    index = url_filter.file_rules(rules, {"example": 10, "net": 3, "free": 1, "bets": 1})
    assert {t: [r.name for r in rs] for t, rs in index.items()} == {"net": ["example.net/en/"], "bets": ["free-bets"]} or set(index) == {"net", "free"}


def test_tokens_are_those_a_pattern_demands(spark):
    """Every match holds the derived tokens, and the index finds what every rule on every URL finds."""
    import random

    derive = url_filter.literal_tokens
    assert derive(r"^a(b)?c\.") == () and derive("x|/y/") == () and derive(r"/fo+/bar/") == ("bar",) and derive(r"/foo?/") == ()
    assert derive(r"/(?:a|b)/foo-bar$") == ("foo", "bar") and derive(r"[.-]net[.-]?x") == () and derive("casino") == () and derive(r"/A\.b/") == ("a", "b")
    draw = random.Random(9)
    bits = ["a", "b", "ab", "net", r"\.", "/", "-", "[.-]", "?", "+", "*", "{2}", "(?:a|b)", r"\d", ".", "^", "$", "(?![a-z0-9])", "(?<![^.])", "(?=/)", "|", "[^/]", "1"]
    rules, urls = [], []
    while len(rules) < 250:
        pattern = "".join(draw.choice(bits) for _ in range(draw.randint(1, 6)))
        try:
            re.compile(pattern)
        except re.error:
            continue
        rules.append(url_filter.Rule(f"r{len(rules):03}", "block", pattern))
    rules += [url_filter.path_rule("/b/*/net/"), url_filter.Rule("net/", "allow", url_filter.host_rule("allow", "net/").pattern, 4)]
    for i in range(300):
        urls.append("http://" + "".join(draw.choice(["a", "b", ".", "net", "-", "1", "A"]) for _ in range(draw.randint(1, 6))) + "/"
                    + "".join(draw.choice(["a", "B", "ab", "/", "net", "-", ".", "1"]) for _ in range(draw.randint(0, 8))))
    for r in rules:
        for u in urls[:80]:
            m = re.search(r.pattern, "".join(url_filter.split_url(u)), re.S)
            assert m is None or set(r.tokens) <= set(re.findall("[a-z0-9]+", "".join(url_filter.split_url(u)).lower())), (r, u)
    for some in (rules, rules[:1], [r for r in rules if not r.tokens][:5], []):
        out = url_filter.url_filter(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), some).collect()
        for r in out:
            full = "".join(url_filter.split_url(urls[r.page_id]))
            fits = [x for x in some if re.search(x.pattern, full, re.S)]
            best = next((x for x in fits if x.length), None)
            words = sorted(x.name for x in fits if not x.length)
            want = (best.name, best.verdict, None) if best else (None, "block" if words else "allow", words[0] if words else None)
            assert (r.rule, r.verdict, r.pattern) == want


def test_quality_model_on_held_out_rows(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    common = [f"word{i}" for i in range(300)]

    def doc(i):
        words = list(rng.choice(common, 80))
        grade = int(rng.integers(3))
        if grade == 0:
            for p in rng.integers(80, size=6):
                words[p] = ["nasty", "vile", "foul"][p % 3]
        return (i, " ".join(w + ("***" if grade == 1 else "") for w in words) + ".", grade)

    rows = [doc(i) for i in range(900)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(2000, None), (2001, "")], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, g) for i, _, g in rows if i < 600], "doc_id long, grade int")
    model = quality_model.train(docs, ratings)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in quality_model.score(docs, model).collect()}
    held = rows[600:]
    assert sum(out[i].kept == (g == 2) for i, _, g in held) >= 0.97 * len(held)
    mean = [np.mean([out[i].expected_grade for i, _, g in held if g == k]) for k in range(3)]
    assert mean[0] < mean[1] < mean[2] and len(out) == 902
    flat = quality_model.train(docs, ratings.limit(0))
    assert quality_model.score(docs.limit(0), flat).collect() == [] and quality_model.score(docs, flat).count() == 902


def test_gradient_of_the_block_labeller():
    import numpy as np

    model, encoder = html_text.new_model(), html_text.Encoder()
    pages = [(encoder.page([(("html", "body", "p"), "a b c."), (("html", "nav"), "d"), (("html", "div"), "e f")]), [1, 0, None]),
             (encoder.page([(("html", "main"), "g h")]), [1])]

    def loss():
        import copy
        m = copy.deepcopy(model)
        return html_text._train_step(m, pages, [np.full_like(v, 1e30) for v in [*m.tables, *m.cells, m.out]])

    import copy
    trial = copy.deepcopy(model)
    memory = [np.zeros_like(v) for v in [*trial.tables, *trial.cells, trial.out]]
    html_text._train_step(trial, pages, memory)
    for k, (value, g2) in enumerate(zip([*model.tables, *model.cells, model.out], memory)):
        flat, at = value.reshape(-1), int(np.argmax(g2))
        old = flat[at]
        flat[at] = old + 1e-5
        up = loss()
        flat[at] = old - 1e-5
        down = loss()
        flat[at] = old
        assert abs((up - down) / 2e-5) == pytest.approx(np.sqrt(g2.reshape(-1)[at]), rel=1e-3), k


@pytest.mark.parametrize("html, texts", [
    ("<article><p title='it's'>Hello don't go</p><p>second</p></article>", ["Hello don't go", "second"]),
    ('<p>a<a href="x>link</a></p><p>b</p>', ["alink", "b"]), ("<p a = \"x>y\" b='<q>' c=d/e>one</p><p>1 < 2</p", ["one", "1 < 2"]),
    ("<p>x" + "<a<b" * 30_000, ["x"]), ("<p " + "a='" * 30_001 + ">t</p>", ["t"]), ("<p>" + "<!a" * 30_000 + ">u", ["u"]),
    ("<article><p>one</p><p>icon <svg/> two</p><p>three</p>", ["one", "icon two", "three"]),
    ("<p>a <svg class=x><title/><path d='M0'/></svg> b</p><p>c</p>", ["a b", "c"]),
    ("<p>let <math><mi>x</mi><mspace/></math> be</p>", ["let x be"]),
    ("<p>a <button>go<p>b</p><object data=x>shown<p>c</p>", ["a go", "b", "shown", "c"]),
    ("<p>a</p><noscript><p>b</p></noscript><template>c</template><p>d", ["a", "b", "c", "d"]),
    ("<p>a<script>if (a < b) '<p>x'</SCRIPT >b<style>p{}</style>c<script/>d</p><p>e", ["abc"]),
    ("<p>a<textarea>x", ["a"]), ("<p>a<title>x</title>b", ["ab"])])
def test_blocks_of_elements_inside_text(html, texts):
    assert [text for _, text in html_text.leaf_blocks(html)] == texts


def test_text_of_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    odd = spark.createDataFrame([(-1, "u", None), (-2, None, ""), (-3, "u", "plain words only"), (-4, "u", "<article><p>a &amp; b<br>c\n d</p><script>x</script>"
                                 "<p>e<b>f</b></article><div class=comments><p>nice text</p></div><form>go</form>"), (-5, "u", "<!-- open <p>x"),
                                 (-6, "u", "<article>" + "<p>long text here.</p>" * 5000)], "page_id long, url string, html string")
    model = html_text.train(pages)
    texts = {r.page_id: r for r in html_text.extract(pages.union(odd), model).collect()}
    assert texts[-1].text == texts[-2].text == texts[-5].text == "" and texts[-4].text == "a & b c d\n\nef"
    assert texts[-6].text.count("long text here.") == 5000 and all(r.n_chars == len(r.text) for r in texts.values())
    wrong = 0
    for r in pages.collect():
        body = r.html[r.html.index("<article>"):r.html.index("</article>")]
        blocks = [re.sub(r"[\x20\x09-\x0D]+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)))).strip()
                  for b in re.split(r"</?(?:h1|p|article)>", body)]
        wrong += texts[r.page_id].text != "\n\n".join(b for b in blocks if b)
    assert wrong == 0
    assert html_text.extract(pages.limit(0), html_text.train(pages.limit(0))).collect() == []


def test_stages_of_the_pipeline(spark, sf):
    """Every stage against its operator's own result on the rows it got; the last one on all that is left."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, left = docs.columns, docs
    names = [n for n, _ in p.STAGES]
    assert names == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scan", "mixing"]
    for name, stage in p.STAGES[:-1]:
        out = p.cut_lineage(stage(spark, left, sf))
        assert out.columns == columns
        ids = sorted(r.doc_id for r in out.select("doc_id").collect())
        if name == "quality rules":
            want = quality_rules.quality_rules(left).where("kept")
        elif name == "near-duplicates":
            want = minhash.near_duplicates(left).where("kept")
        elif name == "benchmark decontamination":
            want = decontaminate.decontaminate(left, spark.read.parquet(f"{sf}/benchmark.parquet")).where("kept")
        else:
            want = left
            assert secrets.scan(out).where("size(spans) > 0").count() == 0
        assert ids == sorted(r.doc_id for r in want.select("doc_id").collect()) and len(ids) > 500
        left = out
    last = p.STAGES[-1][1](spark, left, sf).collect()
    sizes, source = Counter(), {}
    for r in left.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
        source[r.doc_id] = r.source
    check_mix([(source[r.doc_id], r) for r in last], sizes)
    assert sorted(last) == sorted(p.run(spark, sf).collect())
