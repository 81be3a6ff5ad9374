"""Every query over a table of hard cases and over empty tables, against brute force."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from auditframe.llm import registry

from .conftest import documents

DOCS = documents()


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def rows_of(spark, name, tables):
    return registry.QUERIES[name](spark, tables).collect()


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_empty_tables(spark, no_rows, name):
    assert rows_of(spark, name, no_rows) == []


def test_warc(spark, tables):
    got = rows_of(spark, "op1_warc", tables)
    pages = spark.read.parquet(f"{tables}/pages.parquet").collect()
    least = {}
    for p in pages:
        if p.page_id is not None:
            t = p.html or ""
            least[t] = min(least.get(t, p.page_id), p.page_id)

    def of(p):
        t, n = p.html or "", len((p.html or "").encode())
        first = least.get(t)
        revisit = n >= 100 and first is not None and (p.page_id is None or p.page_id > first)
        return (p.page_id, n, sha(t), "revisit" if revisit else "response", first if revisit else None)

    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(repr(of(p)) for p in pages)


def test_warc_reconstruction(spark, tables, tmp_path):
    from auditframe.llm import warc

    pages = spark.read.parquet(f"{tables}/pages.parquet")
    warc.write_archive(pages, f"file://{tmp_path}/a")
    for r in warc.read_archive(spark, f"file://{tmp_path}/a").collect():
        record, payload = bytes(r.record), bytes(r.payload)
        head, _, rest = record.partition(b"\r\n\r\n")
        length = int(re.search(rb"Content-Length: (\d+)$", head)[1])
        assert rest[length:] == b"\r\n\r\n" and record.startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode())
        if r.record_type == "response":
            assert rest[:length].partition(b"\r\n\r\n")[2] == payload
        assert sha(payload) == r.payload_digest and b"sha256:" + r.payload_digest.encode() in head
    stored = spark.read.parquet(f"file://{tmp_path}/a/payloads")
    assert stored.count() == pages.selectExpr("coalesce(html, '') h").distinct().count()


def test_bpe(spark, tables):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in DOCS:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert sorted(map(repr, map(tuple, rows_of(spark, "op2_bpe", tables)))) == sorted(map(repr, want))


def test_packing(spark, tables):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert 49407 in tok.encode(dict(DOCS)[15], add_special_tokens=False).ids
    ids = lambda t: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
    got = rows_of(spark, "op3_packing", tables)
    whole = Counter((i, len(ids(t))) for i, t in DOCS)
    by_id = defaultdict(list)
    for i, t in DOCS:
        by_id[i].append(ids(t))
    covered = Counter()
    windows = defaultdict(list)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in by_id[r.doc_id])
        covered[(r.doc_id, r.doc_tokens)] += r.length
        windows[r.sequence_id].append((r.offset, r.length))
    assert covered == Counter({k: k[1] * n for k, n in whole.items()})
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 4096
    assert len(windows) - sum(sum(n for _, n in p) for p in windows.values()) / 4096 <= 3  # a window for each partition


def placed_by_rule(level, size, window, opening):
    """(cost, choice) of the definition; None if no window has room."""

    def cost(at):
        after = level.copy()
        if at:
            after[at] -= 1
        if at + size < window:
            after[at + size] += 1
        return int((after.astype(int) ** 2).sum())

    able = [0] * opening + [h for h in range(1, window - size + 1) if level[h]]
    return min(able, key=lambda h: (cost(h), -h)) if able else None


def test_sum_of_squares_places_like_the_definition():
    from auditframe.llm.packing import SumOfSquares

    rng, packer, window = np.random.default_rng(1), SumOfSquares(20), 20
    for i in range(300):
        size = int(rng.integers(1, 20))
        level = packer.level.copy()
        best = placed_by_rule(level, size, window, True)
        full = list(packer.add((i, 0, b"1234" * size, size)))
        expected = level.copy()
        if best:
            expected[best] -= 1
        if best + size < window:
            expected[best + size] += 1
        assert (packer.level == expected).all() and len(full) == (best + size == window)


@pytest.mark.parametrize("most, sizes", [(3, (1, 20)), (8, (1, 20)), (1, (11, 20)), (5, (11, 12)), (1000, (1, 6))])
def test_sum_of_squares_with_few_windows(most, sizes):
    from auditframe.llm.packing import SumOfSquares

    rng, window = np.random.default_rng(2), 20
    packer, out, docs = SumOfSquares(window, most), [], {}
    for i in range(400):
        n = int(rng.integers(*sizes))
        docs[i] = rng.integers(0, 1000, n).astype("<u4").tobytes()
        if len(docs[i]) // 4 < window and packer.count == most:  # a cut fills a window of the commonest level
            if placed_by_rule(packer.level, n, window, False) is None:
                at = max((h for h in range(1, window) if packer.level[h]), key=lambda h: (packer.level[h], h))
                first, *more = packer.add((i, 0, docs[i], n))
                assert len(first[-1][2]) // 4 == window - at
                out += [first, *more]
                continue
        out += packer.add((i, 0, docs[i], n))
        assert packer.count <= most and packer.count == packer.level.sum() == sum(map(len, packer.open.values()))
    assert all(sum(len(x[2]) for x in w) == 4 * window for w in out)
    out += packer.rest()
    found = {}
    for doc, start, data, total in sorted(x for w in out for x in w):
        assert len(found.setdefault(doc, b"")) == 4 * start and total == len(docs[doc]) // 4
        found[doc] += data
    assert found == docs
    assert len(out) == -(-sum(map(len, docs.values())) // (4 * window))  # less than one window of padding


def test_chunks_fall_back():
    from auditframe.llm.packing import Chunks

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, known = Tokenizer.from_file(path), Chunks(path)
    words = ["plain", "a~b", "~", "x<|endoftext|>y", "", "\u00e9\u0301", "tab\tbed"]
    known.mark = np.array([0, 1])  # as if the mark did not come back as one id
    got = known.learn(set(words))
    assert all(np.frombuffer(got[w], "<u4").tolist() == tok.encode(w, add_special_tokens=False).ids for w in words)


def words_alike(a: str, b: str) -> float:
    a, b = a.lower().split(), b.lower().split()
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return 1 - p[-1] / max(len(a), len(b), 1)


@pytest.mark.parametrize("few", [300_000, 0])
def test_near_duplicates(spark, tables, few):
    from auditframe.llm import neardup

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = neardup.near_duplicates(docs, broadcast_keys=few).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in DOCS)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, r.class_id)
    short = [(i, t or "") for i, t in DOCS if i is not None and len(t or "") < 2000]
    label = {i: i for i, _ in short}
    for x, (i, a) in enumerate(short):
        for j, b in short[:x]:
            if words_alike(a, b) >= 0.8:
                old, new = sorted((label[i], label[j]), reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    assert {i: of[i] for i in label} == label


@pytest.mark.parametrize("low, high", [(0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.0)])
@pytest.mark.parametrize("kinds", ["s", "i", "d", "sid"])
def test_near_duplicate_recall_by_similarity(low, high, kinds):
    """Words substituted, inserted and deleted: pairs of the band that share a bucket."""
    import random

    from auditframe.llm import neardup as nd

    rng, hashes, found, n = random.Random(3), nd.WordHashes(), 0, 0
    while n < 150:
        a, b = [str(rng.randint(0, 5000)) for _ in range(rng.randint(60, 400))], []
        rate = rng.uniform(1 - high, 1 - low)
        for w in a:
            kind = rng.choice(kinds) if rng.random() < rate else "k"
            b += {"k": [w], "s": [f"z{rng.random()}"], "i": [w, f"z{rng.random()}"], "d": []}[kind]
        if not low <= (nd.similarity_of(a, b, 0.8) or 0) < high:
            continue
        x, y = nd.sketch(*nd.labelled_shingles([a, b], hashes))
        found, n = found + bool(set(x.tolist()) & set(y.tolist())), n + 1
    assert found >= 0.9 * n, found / n


@pytest.mark.parametrize("few", [300_000, 0])
def test_crowded_buckets_lose_no_class(spark, few):
    """A passage that many texts share fills buckets with unlike texts; pairs of near copies among them are found."""
    import random

    from auditframe.llm import neardup

    rng = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    docs, twin = [], {}
    for i in range(120):
        own = [f"w{rng.randint(0, 9999)}" for _ in range(60)]
        docs.append((2 * i, f"{passage} {' '.join(own)}"))
        if i % 3 == 0:
            for k in rng.sample(range(60), 12):
                own[k] = f"x{rng.randint(0, 9999)}"
            docs.append((2 * i + 1, f"{passage} {' '.join(own)}"))
            twin[2 * i + 1] = 2 * i
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), broadcast_keys=few).collect()}
    assert all(got[i] == i for i, _ in docs if i not in twin)
    assert sum(got[i] == j for i, j in twin.items()) >= 0.95 * len(twin)


def chained_texts() -> tuple[list[str], list[int]]:
    """Chains of lightly edited texts among many that share a passage, and their classes by all pairs with a common bucket."""
    import random

    from auditframe.llm import neardup as nd

    rng = random.Random(5)
    passage, texts = [f"p{i}" for i in range(30)], []
    for _ in range(60):
        own = [f"w{rng.randint(0, 9999)}" for _ in range(rng.randint(60, 90))]
        for _ in range(rng.randint(1, 5)):
            texts.append(" ".join(passage + own))
            for k in rng.sample(range(len(own)), 18):
                own[k] = f"x{rng.randint(0, 9999)}"
    sketches = [set(x.tolist()) for x in nd.sketch(*nd.labelled_shingles([t.split() for t in texts], nd.WordHashes()))]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sketches[i] & sketches[j] and nd.similarity_of(texts[i].split(), texts[j].split(), 0.8) is not None:
                old, new = sorted((label[i], label[j]), reverse=True)
                label = [new if v == old else v for v in label]
    return texts, label


@pytest.mark.parametrize("few", [300_000, 0])
@pytest.mark.parametrize("part", [512, 7])
def test_no_link_within_a_bucket_is_lost(spark, monkeypatch, few, part):
    """Chains of lightly edited texts among many that share a passage: every two alike texts with a common bucket are in one class."""
    from auditframe.llm import neardup as nd

    monkeypatch.setattr(nd, "PART", part)
    texts, label = chained_texts()
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), broadcast_keys=few).collect()}
    assert [got[i] for i in range(len(texts))] == label


def test_candidates_are_made_once_for_each_text(spark):
    """A text's buckets that name the same ends make one row for each end (the code before made two for each bucket)."""
    from auditframe.llm import neardup as nd

    who = lambda k, n=100: (bytes([k]), n)
    rows = [(b, who(k), who(0), who(1)) for k in range(8) for b in range(60)] + [(60, who(8, 10), who(0), who(8, 10)), (61, who(9), who(9), who(7)), (61, who(7), who(9), who(7))]
    kind = "struct<node: binary, n: int>"
    members = spark.createDataFrame(rows, f"bucket long, who {kind}, lo {kind}, hi {kind}")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = nd._pairs(members, ["lo", "hi"], 0.8)
        got = {(r.a[0], r.b[0]) for r in found.collect()}

        def made(node) -> int:
            own = node.metrics().get("numOutputRows").get().value() if node.nodeName() == "Generate" else 0
            return own + sum(made(node.children().apply(i)) for i in range(node.children().size()))

        assert 0 < made(found._jdf.queryExecution().executedPlan()) <= 2 * 10
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert {frozenset(p) for p in got} == {frozenset(p) for p in [(0, 1), *((k, e) for k in range(2, 8) for e in (0, 1)), (7, 9)]}


def test_unlinked_candidates_are_not_written(spark, tmp_path, monkeypatch):
    """Texts of the same words in other orders pass every bound but are no links: what the rest writes grows with the texts, not with their pairs."""
    import random

    from auditframe.llm import neardup as nd

    rng, passage = random.Random(9), [f"p{i}" for i in range(30)]
    words, docs = [f"w{i}" for i in range(60)], []
    for i in range(100):
        rng.shuffle(words)
        docs.append((i, " ".join(passage + words)))
    monkeypatch.setattr(nd, "shared_dir", lambda _: str(tmp_path / "shared"))
    _, labels = nd.links(spark.createDataFrame(docs, "doc_id long, text string"))
    assert labels.count() == 0
    sizes = {str(f.parent.relative_to(tmp_path)): spark.read.parquet(str(f.parent)).count() for f in (tmp_path / "shared" / "rest").rglob("_SUCCESS")}
    buckets = spark.read.parquet(str(tmp_path / "shared" / "shared")).count()
    assert sizes and max(sizes.values()) <= max(buckets, 100) < 100 * 99 // 2, (sizes, buckets)


def test_keep_one_of_chained_texts(spark, tmp_path):
    """The pipeline stage keeps the first of each class, though links lie between others than the classes' representatives."""
    from auditframe.llm import neardup as nd

    texts, label = chained_texts()
    kept = nd.keep_one(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(label))


@pytest.mark.parametrize("gap", [1, 3])
def test_elias_fano_of_dense_values_far_from_zero(gap):
    """A late piece of a large trie: buckets of hundreds of values, each zero alone in its word."""
    from auditframe.llm.lm import EliasFano

    values = (np.arange(400_000) * gap + 400_000 * 300 * gap).astype(np.uint64)
    head, arrays = EliasFano.arrays(values)
    coded = EliasFano(head["n"], head["bits"], *arrays)
    asked = np.arange(int(values[0]) - 5, int(values[-1]) + 5, 41).astype(np.uint64)
    place = (asked.astype(np.int64) - int(values[0])) // gap
    there = (place >= 0) & (place < len(values)) & ((asked - values[0]) % np.uint64(gap) == 0)
    assert np.array_equal(coded.find(asked), np.where(there, place, -1))


def test_word_counts_leave_out_no_link():
    import random

    from auditframe.llm import neardup as nd

    rng, hashes, words = random.Random(6), nd.WordHashes(), [[], ["a"], ["a", "b"]]
    for n in (5, 200, 3000):
        base = [f"w{rng.randint(0, n // 2)}" if rng.random() < 0.7 else "often" for _ in range(n)]
        for _ in range(20):
            b = list(base)
            for _ in range(rng.randint(0, n // 3)):
                k = rng.randrange(len(b))
                b[k : k + 1] = rng.choice([["z"], ["new"], [b[k], f"y{rng.randint(0, 9)}"]])
            words.append(b)
    n, marks = np.array([len(w) for w in words]), np.ones(len(words), bool)
    counts = nd.word_counts(words, hashes)
    pairs = set(zip(*(x.tolist() for x in nd.possible(n, counts, np.arange(len(words)), marks, marks, 0.8))))
    alike = {(i, j) for i in range(len(words)) for j in range(len(words)) if i != j and nd.similarity_of(words[i], words[j], 0.8) is not None}
    assert alike and alike <= pairs
    assert np.array_equal(nd.word_counts([["a"]] * 1025, hashes), np.repeat(nd.word_counts([["a"]], hashes), 1025, 0))


def test_sketch_of_very_long_texts(monkeypatch):
    from auditframe.llm import neardup as nd

    texts = [["a", "b", "c", "d", "e", "f"], [f"w{i}" for i in range(500)], [f"w{i}" for i in range(3, 503)]]
    monkeypatch.setattr(nd, "POSITION_BITS", 4)
    whole = nd.sketch(*nd.labelled_shingles(texts, nd.WordHashes()))
    for i, words in enumerate(texts):
        assert (nd.sketch(*nd.labelled_shingles([words], nd.WordHashes()))[0] == whole[i]).all()
    assert len(set(whole[1].tolist()) & set(whole[2].tolist())) > 20


@pytest.mark.parametrize("few", [200_000, 0])
@pytest.mark.parametrize("ids", ["all", "none", "clustered", "repeated"])
def test_every_text_meets_its_successor(spark, monkeypatch, few, ids):
    from auditframe.llm import fingerprints as fp

    monkeypatch.setattr(fp, "RANGE_ROWS", 4)
    monkeypatch.setattr(fp, "BLOCK", 3)
    of = {"all": lambda i: i * 7 - 300, "none": lambda i: None, "clustered": lambda i: i if i < 60 else i * 10**15, "repeated": lambda i: i // 5}[ids]
    docs = [(of(i), f"text {i * 37 % 90}") for i in range(90)]
    got = fp.edited_pairs(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), broadcast_ranges=few).collect()
    if ids == "none":  # in order of a hash: one cycle through all texts
        follow = {r.text: r.next_text for r in got}
        at, seen = got[0].text, []
        for _ in docs:
            seen.append(at)
            at = follow[at]
        assert sorted(seen) == sorted(t for _, t in docs) and at == seen[0]
        return
    order = sorted(docs)
    assert sorted((r.doc_id, r.text, r.next_text) for r in got) == [(i, t, order[(k + 1) % 90][1]) for k, (i, t) in enumerate(order)]


def test_fingerprints(spark, tables):
    got = rows_of(spark, "op5_fingerprints", tables)
    order = sorted(((i is not None, i or 0, (t or "")) for i, t in DOCS), key=lambda x: (x[0], x[1], x[2].encode()))
    want = []
    for k, (known, i, t) in enumerate(order):
        n = order[(k + 1) % len(order)][2]
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        want.append((i if known else None, len(t), sha(edited)))
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(repr, want))
    texts = defaultdict(set)
    for i, t in DOCS:
        if i is not None:
            texts[t or ""].add(i)
    prints = defaultdict(set)
    for r in got:
        prints[r.doc_id].add(r.fingerprint)
    for ids in texts.values():
        assert len(set.union(*(prints[i] for i in ids))) == 1
    shingles = lambda t: {tuple(w[k : k + 5]) for w in [t.split()] for k in range(len(w) - 4)} or {tuple(t.split())}
    errors = []
    near = {(r.doc_id, r.n_chars): r.near_edited for r in got}
    for k, (known, i, t) in enumerate(order):
        edited = t[: len(t) - len(t) // 2] + order[(k + 1) % len(order)][2][: len(t) // 2]
        a, b = shingles(t), shingles(edited)
        if known and len(t) > 300:
            errors.append(near[(i, len(t))] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.08


@pytest.mark.parametrize("few", [300_000, 0])
def test_line_dedup(spark, tables, few):
    from auditframe.llm import linededup

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {(r.doc_id, r.n_chars): r for r in linededup.drop_recurring(docs, broadcast_keys=few, read="n_read", dropped="n_dropped").collect()}
    boiler = {"All rights are reserved here."}
    for i, t in DOCS:
        r = got[(i, None if t is None else len(t))]
        if t is None:
            assert r.text is None and r["n_dropped"] == 0
            continue
        templated = re.sub(r"Read \d+ times since \d+ by us", "Read", t)
        first = {14: 0, 20: 1}.get(i)
        keep = [line for line, short in zip(t.split("\n"), templated.split("\n")) if not (short in boiler and first != 0 or short == "Read" and first != 1)]
        assert r.text == "\n".join(keep), i


@pytest.mark.parametrize("few", [300_000, 0])
def test_long_passages_recur_from_two_texts(spark, few):
    from auditframe.llm import linededup

    passage = {n: " ".join(f"{n}word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)) for n in ("two", "three", "once")}
    short = "only seven words stand in this"
    own = lambda i: f"text of its own {chr(97 + i) * 9}"
    lines = {1: ["two", "three"], 2: ["two"], 3: ["three"], 4: ["three", "once"], 5: []}
    rows = [(i, "\n".join([own(i), *(passage[n] for n in names), short if i < 4 else "end"])) for i, names in lines.items()]
    got = {r.doc_id: r.text for r in linededup.drop_recurring(spark.createDataFrame([*rows, rows[3]], "doc_id long, text string"), broadcast_keys=few).collect()}
    want = {1: ["two", "three"], 2: [], 3: [], 4: ["once"], 5: []}
    assert got == {i: "\n".join([own(i), *(passage[n] for n in names), short if i < 4 else "end"]) for i, names in want.items()}


def tree_brute(docs, min_docs=4):
    """The definition of the module, line by line."""
    from auditframe.llm.linededup import ALIKE, FIELD, LEADING, LONG, LONG_DOCS, parse

    texts = {}
    for i, t in docs:
        texts[t] = min(texts.get(t, i), i)
    seen = {}
    for t in texts:
        for line in t.split("\n"):
            if p := parse(line):
                seen.setdefault(tuple(p[2]), set()).add(t)
    leaf = lambda w: (len(w), w[:LEADING])
    support = Counter()
    for w, where in seen.items():
        for p, t in enumerate(w):
            support[leaf(w), p, t] += len(where)
    able = {}
    for w in seen:
        v = len(w) - math.ceil(ALIKE * len(w) - 1e-9)
        places = [(s if (s := support[leaf(w), p, t]) >= min_docs else 0, p) for p, t in enumerate(w) if t != FIELD]
        mask = lambda out: (leaf(w), tuple(None if p in out else t for p, t in enumerate(w)))  # noqa: B023, E731
        rare = {p for s, p in places if not s}
        by_hash = sorted((s, p) for s, p in places)
        able[w] = ([mask(rare)] if len(rare) <= v else []) + [mask({p for _, p in by_hash[:v]})]
    counts = defaultdict(set)
    for w, ts in able.items():
        for t in ts:
            counts[t] |= seen[w]
    chosen = defaultdict(set)
    for w, ts in able.items():
        good = [t for t in dict.fromkeys(ts) if len(counts[t]) >= min_docs]
        if good:
            chosen[max(good, key=lambda t: (len(counts[t]), -ts.index(t)))].add(w)
    keeper = {}
    for ws in chosen.values():
        who = min((t for w in ws for t in seen[w]), key=texts.get)
        keeper |= {w: who for w in ws}
    for w, where in seen.items():
        if len(w) >= LONG and len(where) >= min(min_docs, LONG_DOCS):
            keeper.setdefault(w, min(where, key=texts.get))
    return {i: "\n".join(x for x in t.split("\n") if not ((p := parse(x)) and keeper.get(tuple(p[2]), t) != t)) for i, t in docs}


@pytest.mark.parametrize("few, partitions", [(300_000, 3), (0, 3), (300_000, 17)])
def test_template_tree_against_brute_force(spark, few, partitions):
    import random

    from auditframe.llm import linededup

    rng = random.Random(5)
    city, name = ["Rome", "Oslo", "Lima", "Bonn", "Kyiv"], [f"name{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    makers = [
        lambda: f"Visit our shop in {rng.choice(city)} for the best prices of {rng.randint(1, 99)}",
        lambda: f"Visit our shop with {rng.choice(name)} for the best prices of today",
        lambda: f"Written by our own {rng.choice(name)} for readers of {rng.choice(city)} and all their friends in the wide world out there",
        lambda: "All rights are reserved here",
        lambda: f"one two {rng.choice(city)}",
        lambda: " ".join(rng.choice(name[:6]) for _ in range(rng.randint(3, 25))),
        lambda: " ".join(str(rng.randint(1, 9)) for _ in range(4)),
        lambda: rng.choice(["", "two words", f"Seen on our site by {rng.choice(name)} and by {rng.choice(name)} and then shared with the others"]),
    ]
    docs = [(i, "\n".join(rng.choice(makers)() for _ in range(rng.randint(0, 7)))) for i in range(300)]
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(partitions)
    got = {r.doc_id: r.text for r in linededup.drop_recurring(rows, broadcast_keys=few).collect()}
    want = tree_brute(docs)
    assert got == want and sum(map(len, want.values())) < 0.9 * sum(len(t) for _, t in docs)
    assert linededup.parse("too short") is None


def lm_brute(train: list[str], texts: list[str]):
    token = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w] + ["\0"]
    c, c2, c3 = Counter(), Counter(), Counter()
    for t in train:
        s = ["\0", *token(t)]
        c.update(s[1:])
        c2.update(zip(s, s[1:]))
        c3.update(zip(s, s[1:], s[2:]))
    n, v = sum(c.values()), len(c)
    k2, k3 = c2, {k: x for k, x in c3.items()}
    m2, m3 = Counter(), Counter()
    for (a, _), x in k2.items():
        m2[a] += (x - 0.75) / c[a]
    for (a, b, _), x in k3.items():
        m3[(a, b)] += (x - 0.75) / c2[(a, b)]
    for t in texts:
        s = ["\0", *token(t)]
        base = score = 0.0
        for i in range(1, len(s)):
            one = (c[s[i]] + 1) / (n + v + 1)
            base += math.log10(one)
            pair = (s[i - 1], s[i])
            p = (k2[pair] - 0.75) / c[s[i - 1]] if pair in k2 else 0.0
            p += (1 - m2[s[i - 1]]) * one
            if i > 1 and (s[i - 2], s[i - 1]) in m3:
                context = (s[i - 2], s[i - 1])
                p = (k3[(*context, s[i])] - 0.75 if (*context, s[i]) in k3 else 0.0) / c2[context] + (1 - m3[context]) * p
            score += math.log10(p)
        yield len(s) - 1, sum(c[w] > 0 for w in s[1:]), n, base, score


@pytest.mark.parametrize("small", [False, True])
def test_lm(spark, tables, monkeypatch, small):
    from auditframe.llm import lm

    if small:
        for name, value in (("PIECE_BYTES", 50_000), ("PIECE_TOKENS", 3_000), ("SLICE_TOKENS", 2_000)):
            monkeypatch.setattr(lm, name, value)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    want = list(lm_brute([t or "" for i, t in DOCS if not held(i)], [t or "" for _, t in DOCS]))
    key = lambda i, n, k, b: (str(i), n, k, round(b, 3))
    expected = Counter(key(i, w[0], w[1], w[3]) for (i, _), w in zip(DOCS, want))
    got = rows_of(spark, "op7_lm", tables)
    assert Counter(key(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in got) == expected
    scores = {key(i, w[0], w[1], w[3]): w for (i, _), w in zip(DOCS, want)}
    for r in got:
        w = scores[key(r.doc_id, r.n_tokens, r.n_known, r.base_score)]
        assert r.train_tokens == w[2] and r.held_out == held(r.doc_id) and abs(r.score - w[4]) <= 0.05 * r.n_tokens + 0.01


@pytest.mark.parametrize("small", [False, True])
def test_lm_keeps_ngrams_seen_once(spark, tables, monkeypatch, small):
    from auditframe.llm import lm

    if small:
        for name, value in (("PIECE_BYTES", 50_000), ("PIECE_TOKENS", 3_000), ("SLICE_TOKENS", 2_000)):
            monkeypatch.setattr(lm, name, value)
    token = lambda t: ["", *[w.decode("utf-8", "surrogatepass") for w in lm.words_of(t)], ""]
    c, c2, c3 = Counter(), Counter(), Counter()
    for i, t in DOCS:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            s = token(t)
            c.update(s[1:])
            c2.update(zip(s, s[1:]))
            c3.update(zip(s, s[1:], s[2:]))
    m2, m3 = Counter(), Counter()
    for (a, _), n in c2.items():
        m2[a] += (n - 0.75) / c[a]
    for (a, b, _), n in c3.items():
        m3[a, b] += (n - 0.75) / c2[a, b]
    want = Counter()
    for i, t in DOCS:
        s, score = token(t), 0.0
        for j in range(1, len(s)):
            a, b = s[j - 1 : j + 1]
            p = (1 - m2[a]) * (c[b] + 1) / (sum(c.values()) + len(c) + 1)
            p += (c2[a, b] - 0.75) / c[a] if (a, b) in c2 else 0.0
            if j > 1 and (s[j - 2], a) in m3:
                p *= 1 - m3[s[j - 2], a]
                p += (c3[s[j - 2], a, b] - 0.75) / c2[s[j - 2], a] if (s[j - 2], a, b) in c3 else 0.0
            score += math.log10(p)
        want[i] += score
    got, n = Counter(), Counter()
    for r in rows_of(spark, "op7_lm", tables):
        got[r.doc_id] += r.score
        n[r.doc_id] += r.n_tokens
    assert all(abs(got[i] - want[i]) <= 0.05 * n[i] + 0.01 for i in want) and set(got) == set(want)


@pytest.mark.parametrize("few", [200_000, 0])
def test_media(spark, tables, tmp_path, few):
    from auditframe.llm import media

    path = f"file://{tmp_path}/m"
    media.write_media(spark.read.parquet(f"{tables}/documents.parquet"), path, broadcast_digests=few)
    rows, read = media.read_media(spark, path)
    files = {r.file: bytes(r.media) for r in read.collect()}
    payloads = Counter((r.doc_id, r.n_bytes, sha(media.from_wav(files[r.file]))) for r in rows.collect())
    want = Counter((i, len((t or "").encode()), sha(media.padded((t or "").encode()))) for i, t in DOCS)
    assert payloads == want and len(files) == len({media.padded((t or "").encode()) for _, t in DOCS})


def test_media_query(spark, tables):
    from auditframe.llm import media

    for r in rows_of(spark, "op8_media", tables):
        payload = next(p for i, t in DOCS if i == r.doc_id and len((t or "").encode()) == r.n_bytes for p in [media.padded((t or "").encode())])
        wav = media.to_wav(payload)
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == (len(payload), sha(payload), zlib.crc32(payload[-64:]), len(wav), sha(wav))


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t: str) -> list[tuple]:
    luhn = lambda d: sum(int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m)
    good = {"email": lambda m: True, "ip": lambda m: all(int(x) <= 255 for x in m.split(".")), "card": lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m)), "phone": lambda m: 9 <= len(digits(m)) <= 15}
    return sorted((m.start(), k, m.end()) for k, (name, p) in enumerate(BASE.items()) for m in re.finditer(p, t) if good[name](m[0]))


TRICKY = ["a@b.c_x@d.e", "1.2.3.4.5.6.7.8 9.9.9.999", "4111-1111-1111-1111  4111--1111", "+1+2 (3) 456 789 012.", "@ . 1", "x@y x@y.z.", "é a@b.c 漢 1.1.1.1"]


def test_pii_base(spark, tables):
    from auditframe.llm import pii

    names = list(BASE)
    for r in rows_of(spark, "op9_pii", tables):
        ok = [t or "" for i, t in DOCS if i == r.doc_id]
        assert any((sha(",".join(f"{names[k]}:{a}:{b}" for a, k, b in s)), [r.n_email, r.n_ip, r.n_card, r.n_phone]) == (r.base_sha256, [sum(k == j for _, k, _ in s) for j in range(4)]) for s in map(base_spans, ok))
    df = spark.createDataFrame([(t,) for t in TRICKY], "t string")
    for r in df.select("t", pii.base_spans(df.t).alias("s")).collect():
        assert [tuple(x) for x in r.s] == base_spans(r.t), r.t


def test_pii_finds_what_follows_learned_contexts(spark, tables):
    spans = {r.doc_id: r.spans for r in rows_of(spark, "op9_pii", tables)}
    for i, t in DOCS:
        if i is not None and 100 <= i < 110:
            m = re.search(r'token = "(\w+)"', t)
            assert f"id:{m.start(1)}:{m.end(1)}" in spans[i].split(",")
    assert spans[1] == "" and "id:" not in spans[14]


def test_pii_bootstraps_from_context_to_context(spark):
    """Seeds after one word reveal plain ids there; those reveal a second word, and that one further ids; then in any context."""
    from auditframe.llm import pii

    plain = [f"1000{i}7{i}" for i in range(9)]
    docs = [f"login u{i}@c.example.com today" for i in range(4)] + [f"login {x} today" for x in plain[:3]] + [f"handle {x} now" for x in plain[:7]]
    docs += [f"about {plain[5]} once", "about 1999999 once"] + [f"costs {i}00.000 each" for i in range(9)] + [f"the {x} thing" for x in plain[7:]] + ["the other one"] * 9
    rows = pii.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    found = {docs[r.doc_id][x.start : x.end] for r in rows for x in r.extra}
    assert found == set(plain[:7])
    assert [x for r in rows if docs[r.doc_id].startswith("about") for x in r.extra] != []


def test_pii_long_contexts_and_keys(spark):
    from auditframe.llm import pii

    word, key = "w" * 200, "k" * 60
    docs = [f"{word} u{i}@c.example.com" for i in range(4)] + [f"{word}\n\t 77001{i}" for i in range(3)] + [f"{key}=u{i}@c.example.com" for i in range(4)] + [f"{key}=secret{'x' * i}" for i in range(1, 4)]
    rows = pii.find(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()
    assert {docs[r.doc_id][x.start : x.end] for r in rows for x in r.extra} == {f"77001{i}" for i in range(3)} | {"secret" + "x" * i for i in range(1, 4)}


def test_pii_scores_like_the_definition(spark, tmp_path):
    import random

    from auditframe.llm import pii

    rng = random.Random(1)
    edges = {(f"p{rng.randint(0, 11)}", rng.randint(0, 40)): rng.randint(1, 3) for _ in range(160)}
    seed = {v: rng.choice([0.0, 0.0, 0.8, 1.0]) for v in range(41)}
    total = Counter()
    for (p, _), n in edges.items():
        total[p] += n
    total = {p: float(n + rng.choice([0, 0, 5])) for p, n in total.items()}
    score = dict.fromkeys(total, 0.0)
    value = dict(seed)
    for _ in range(pii.ROUNDS):
        new = {p: sum(n * value[v] for (q, v), n in edges.items() if q == p) / total[p] if sum(value[v] >= pii.KNOWN for q, v in edges if q == p) >= pii.SEEDS else 0.0 for p in total}
        moved = max(abs(new[p] - score[p]) for p in total)
        score = new
        value = {v: max([seed[v], *(score[q] for q, u in edges if u == v)]) for v in seed}
        if moved < pii.STILL:
            break
    e = spark.createDataFrame([(p, v, n, seed[v]) for (p, v), n in edges.items()], "pattern string, value long, n long, seed double")
    got = pii.scored(e, spark.createDataFrame(list(total.items()), "pattern string, total double"), f"file://{tmp_path}/s")
    assert {r.pattern: round(r.score, 9) for r in got.collect()} == {p: round(x, 9) for p, x in score.items()}


def test_pii_mask(spark, tables):
    from auditframe.llm import pii

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    got = {r.doc_id: r for r in pii.mask(spark, docs, tables).collect()}
    assert got[13].text == "mail <EMAIL> and <CARD> or <PHONE> at 10.0.0.256 and <IP>." and got[13].n_chars == len(got[13].text)
    assert got[2].text is None and got[1].text == dict(DOCS)[1]


def test_toxicity(spark, tables):
    got = rows_of(spark, "op10_toxicity", tables)
    assert len(got) == len(DOCS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    by_text = defaultdict(set)
    for r in got:
        for i, t in DOCS:
            if i == r.doc_id and i is not None and i != 7:
                by_text[t or ""].add(r.score)
    assert len(by_text[""]) == 1
    held = [r for r in got if r.held_out and r.doc_id >= 200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    toxic = {i for i, t in DOCS if i is not None and "blork" in (t or "")}
    a, b = [r.score for r in held if r.doc_id in toxic], [r.score for r in held if r.doc_id not in toxic]
    assert np.mean([x > y for x in a for y in b]) > 0.9


def test_toxicity_scores_like_the_definition(spark, tables):
    """Features and trees, value by value, of the fitted model."""
    from auditframe.llm import toxicity as tx

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    model = tx.trained(spark, tables, docs)
    assert model.trees and model.lexicon

    def odds(word):
        w = tx.folded(word)
        return max([model.lexicon.get(u, 0.0) for u in [w + " ", *(w[:n] for n in tx.STEMS if len(w) >= n)]] + [0.0])

    def brute(text):
        tokens = text.split()
        if not tokens:
            x = [0.0] * len(tx.FEATURES)
        else:
            o, you, n = [odds(w) for w in tokens], [tx.folded(w) in tx.SECOND_PERSON for w in tokens], len(tokens)
            strong = [i for i, v in enumerate(o) if v >= tx.STRONG_ODDS]
            near = sum(any(you[j] for j in range(max(0, i - tx.NEAR), min(n, i + tx.NEAR + 1))) for i in strong)
            kinds = Counter(tx._kinds()[ord(c)] for c in text)
            inner = [w.strip(tx.EDGES) for w in tokens]
            mixed = [any(c.isalpha() for c in w) and not w.replace("'", "").replace("-", "").isalpha() for w in inner]
            top = sorted(o)[-3:]
            x = [len(strong) / n, sum(tx.LEAST_ODDS <= v < tx.STRONG_ODDS for v in o) / n, len(strong), max(o), sum(top), sum(o) / n, near / n, sum(you) / n,
                 kinds[2] / max(1, kinds[1] + kinds[2]), kinds[5] / len(text), kinds[6] / len(text), kinds[3] / len(text), sum(mixed) / n, 1 - len(set(tokens)) / n, math.log1p(n)]
        raw = model.base
        for feature, threshold, value in model.trees:
            at = 0
            while at < len(feature):
                at = 2 * at + 1 + (x[feature[at]] > threshold[at])
            raw += value[at - len(feature)]
        xs, ys = model.steps
        return 0.999 * float(np.interp(raw, xs, ys)) + 0.001 / (1 + math.exp(-raw))

    small = {i: t or "" for i, t in DOCS if i is not None and i != 7 and len(t or "") < 5000}
    got = {r.doc_id: r.score for r in tx.score(docs, model).collect()}
    close = [abs(got[i] - brute(t)) < 1e-6 for i, t in small.items()]
    assert np.mean(close) > 0.97  # a sum in another order may cross a threshold


def test_isotonic_is_monotone_and_pools():
    from auditframe.llm.toxicity import isotonic

    x, y = isotonic(np.array([0.0, 1, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1, 0]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all() and y[0] == 0 and np.isclose(np.interp(1.5, x, y), 0.5)


def test_rare_ngrams_keep_a_probability():
    from auditframe.llm import lm

    for least in (0.5, 1e-4, 1.25 / 4e6, 0.25 / 1e10):
        p = np.geomspace(least, 1, 500)
        code, steps = lm.quantised(p)
        back = lm.levels(steps)[code]
        assert (back > 0).all() and (back <= p * (1 + 1e-6)).all() and (back >= p * 10 ** (-1.01 / steps)).all()


@pytest.mark.parametrize("piece", [1 << 20, 64])
def test_word_hashes(monkeypatch, piece):
    from auditframe.llm import lm

    monkeypatch.setattr(lm, "HASH_BYTES", piece)
    lm.powers.cache_clear()
    texts = [t or "" for _, t in DOCS] + ["\x1ca \x85b\u00a0c", "Aa aA AA", " ", "z"]
    data = [t.encode() for t in texts]
    got, counts = lm.word_hashes(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    words = [lm.words_of(t) for t in texts]
    lm.powers.cache_clear()
    assert counts.tolist() == [len(w) for w in words]
    known = dict(zip((w for ws in words for w in ws), got.tolist()))
    assert [known[w] for ws in words for w in ws] == got.tolist() and len(set(known.values())) == len(known)


def test_successors_and_backoff_sum_to_one(spark, tmp_path):
    """Of a context whose successors lie in one piece: what the codes give away is what the backoff lacks, however frequent it is."""
    from auditframe.llm import lm

    class Counts:
        types, tokens = 50, 10**8 + 100

        def counts(self, ids):
            return np.where(ids == 1, 10**8, 2), None

    third = np.arange(2, 42)
    seen = np.where(third == 2, 10**8 - 39, 1)
    blob = lm._packed(np.full(40, 1 * 51 + 1, np.uint64), third.astype(np.uint32), seen.astype(np.uint32))
    group = lm.pa.table({"piece": lm.pa.array([0], lm.pa.int32()), "n": lm.pa.array([40], lm.pa.int32()), "blob": lm.pa.array([blob], lm.pa.binary())})
    lm._merge_trigrams(f"file://{tmp_path}", Counts())((lm.pa.scalar(0, lm.pa.int32()),), group)
    head, arrays = lm.mapped(f"file://{tmp_path}/trie-0")
    code3, back3 = arrays[10], arrays[11]
    share = lm.levels(head["steps"][1])[code3]
    assert (share > 0).all() and len(share) == 40
    left = 1 - share.sum()
    assert 0 < left and abs(np.log10(lm.levels(head["steps"][2])[back3][0] / left)) <= 1.01 / head["steps"][2]


def test_packing_takes_a_batch_in_parts():
    """Texts of few rows of an Arrow batch are Python objects at once; rows and their order stay."""
    import pyarrow as pa

    from auditframe.llm.packing import ROWS_AT_ONCE, pieces_of

    n = 2 * ROWS_AT_ONCE + 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([None if i % 5 == 0 else f"t{i}" for i in range(n)])], ["doc_id", "text"])
    parts = list(pieces_of(iter([batch, batch.slice(0, 0), batch.slice(3, 4)])))
    assert [len(d) for d, _ in parts] == [ROWS_AT_ONCE, ROWS_AT_ONCE, 7, 4]
    rows = [(i, "" if i % 5 == 0 else f"t{i}") for i in range(n)]
    assert [row for d, t in parts for row in zip(d, t)] == rows + rows[3:7]


def packed_trigrams(lm, n: int, parts: int):
    """Count lists of ``parts`` slices, as one group, of a vocabulary of 50,000; one pair has a tenth of the entries."""
    rng, blobs, lists = np.random.default_rng(5), [], []
    for _ in range(parts):
        pair = rng.integers(0, 50_000, n) * 50_001 + rng.integers(0, 50_000, n) % 97
        pair[: n // 10] = 7 * 50_001 + 7
        rows = np.unique(np.stack([pair, rng.integers(0, 50_001, n)]), axis=1)
        seen = rng.integers(1, 5, rows.shape[1])
        lists.append([rows[0].astype(np.uint64), rows[1].astype(np.uint32), seen.astype(np.uint32)])
        blobs.append(lm._packed(*lists[-1]))
    group = lm.pa.table({"piece": lm.pa.array([0] * parts, lm.pa.int32()), "n": lm.pa.array([len(x[0]) for x in lists], lm.pa.int32()), "blob": lm.pa.array(blobs, lm.pa.binary())})
    return lists, group


class FrequentWords:
    types, tokens = 50_000, 10**9

    def counts(self, ids):
        return np.full(len(ids), 10**7), None


def test_merges_of_trigrams_need_little_memory(tmp_path):
    """Two workers of an executor merge at a time: the working arrays follow ``AT_ONCE``, not the piece (before: 204 bytes an entry here)."""
    import tracemalloc

    from auditframe.llm import lm

    lists, group = packed_trigrams(lm, 150_000, 8)
    entries = sum(len(x[0]) for x in lists)
    tracemalloc.start()
    try:
        lm._merge_trigrams(f"file://{tmp_path}", FrequentWords())((lm.pa.scalar(0, lm.pa.int32()),), group)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 110 * entries


def test_merges_of_trigrams_do_not_depend_on_their_ranges(tmp_path, monkeypatch):
    from auditframe.llm import lm

    lists, group = packed_trigrams(lm, 6_000, 5)
    want = Counter()
    for pair, third, seen in lists:
        for key in zip(pair.tolist(), third.tolist(), seen.tolist()):
            want[key[:2]] += key[2]
    files = []
    for size in (1 << 18, 500, 1):  # the frequent pair is more than a range of 500
        monkeypatch.setattr(lm, "AT_ONCE", size)
        pair, third, seen = lm.merged(lists)
        assert list(zip(zip(pair.tolist(), third.tolist()), seen.tolist())) == sorted(want.items())
        if size > 1:
            lm._merge_trigrams(f"file://{tmp_path}/{size}", FrequentWords())((lm.pa.scalar(0, lm.pa.int32()),), group)
            files.append((tmp_path / str(size) / "trie-0").read_bytes())
    assert files[0] == files[1]


def test_elias_fano():
    from auditframe.llm.lm import EliasFano

    rng = np.random.default_rng(0)
    for size, top in ((0, 1), (1, 0), (1, 10**12), (1000, 2000), (5000, 10**9), (3000, 2**61)):
        v = np.unique(rng.integers(0, top + 1, size)).astype(np.uint64)
        head, arrays = EliasFano.arrays(v)
        e = EliasFano(head["n"], head["bits"], *arrays)
        assert (e.access(np.arange(len(v))) == v).all()
        q = np.unique(np.concatenate([v, rng.integers(0, top * 2 + 1, 500).astype(np.uint64)]))
        place = {int(x): i for i, x in enumerate(v)}
        assert e.find(q).tolist() == [place.get(int(x), -1) for x in q]


def test_sketches_do_not_depend_on_the_slice():
    from auditframe.llm import neardup as nd

    texts = [(t or "").lower().split() for _, t in DOCS]
    whole = nd.sketch(*nd.labelled_shingles(texts, nd.WordHashes()))
    for i, words in enumerate(texts):
        assert (nd.sketch(*nd.labelled_shingles([words], nd.WordHashes()))[0] == whole[i]).all()


def test_banded_distance():
    import random

    from auditframe.llm.neardup import distance_within

    random.seed(0)
    for _ in range(500):
        a = [random.choice("abc") for _ in range(random.randint(0, 14))]
        b = [x if random.random() < 0.8 else random.choice("abc") for x in a] + [random.choice("abc")] * random.randint(0, 2)
        most = random.randint(0, 8)
        true = round((1 - words_alike(" ".join(a), " ".join(b))) * max(len(a), len(b), 1))
        assert distance_within(a, b, most) == (true if true <= most else None)
