"""The ten operators against brute force, round trips and held-out accuracy, on awkward rows."""

import hashlib
import math
import random
import re
import resource
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fileloom.llm import chunks, decontam, langid, lm, mixing, neardup, quality, suffixdedup, tokencount, tokenout, warc
from fileloom.llm.queries import QUERIES, SQL, tokenizer_path

from fileloom.llm.shared import flat
from fileloom.llm.words import words

from ..oracle import of_duckdb, of_spark
from .conftest import frame, prose

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    assert of_spark(QUERIES[name](spark, SF)) == of_duckdb(SQL[name], SF)


# 1 --------------------------------------------------------------------------------------------


def test_warc(spark):
    page = "<html>" + "x" * 120
    some = [(1, "http://a/ö?q=1", page), (2, "http://b", page), (3, None, None), (4, "", ""), (5, "http://c", "short"), (6, "http://c", "short"), (0, "http://d", "ü" * 60), (7, "http://e", "ü" * 60), (7, "http://e", page), (None, "http://f", page), (8, "bad [url", "a\r\n\r\nb" * 40), (9, "http://g", "WARC/1.1\r\n" * 20)]
    pages = spark.createDataFrame([(*r, "q", 3) for r in some], "page_id long, url string, html string, digest string, copy int").repartition(3)
    first = {}
    for i, _, h in some:
        d = (h or "").encode()
        if len(d) >= 100 and i is not None:
            first[d] = min(i, first.get(d, i))
    want = []
    for i, _, h in some:
        d = (h or "").encode()
        again = i is not None and d in first and first[d] != i
        want.append((i, len(d), hashlib.sha256(d).hexdigest(), "revisit" if again else "response", first[d] if again else None))
    got = warc.archive_pages(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert rows(got) == sorted(want, key=repr)
    assert warc.archive_pages(pages.limit(0)).count() == 0
    many = warc.archive_pages(spark.createDataFrame([(4, "http://r", page)] * 40 + [(None, None, page)] * 3, "page_id long, url string, html string")).collect()
    assert len(many) == len({r.capture_id for r in many}) == 43 and sum(r.record_type == "revisit" for r in many) == 39


def test_warc_transactions_of_other_archives(spark):
    """Responses that name their request, metadata that name a request, and records without a partner."""

    def found(*rows):
        made = spark.createDataFrame([(kind, i, names, None, None, None, None, None, None, None, None) for kind, i, names in rows], warc.RECORDS)
        return {r.capture_id: (r.response and r.response.record_id, r.request and r.request.record_id, sorted(m.record_id for m in r.metadata)) for r in warc.assemble(made).collect()}

    direct = [("response", "a", []), ("request", "b", ["a", "a"]), ("metadata", "c", ["a"]), ("revisit", "d", None), ("metadata", "e", None), ("warcinfo", "w", ["a"])]
    assert found(*direct) == {"a": ("a", "b", ["c"]), "d": ("d", None, [])}
    assert found(*direct, ("metadata", "f", ["b"]), ("metadata", "g", ["gone"])) == {"a": ("a", "b", ["c", "f"]), "d": ("d", None, [])}
    assert found(("response", "a", ["b"]), ("request", "b", []), ("metadata", "c", ["b"])) == {"a": ("a", "b", ["c"])}


def test_warc_keeps_a_very_long_payload(spark):
    page = "<p>long é</p>" * 400_000
    got = warc.archive_pages(spark.createDataFrame([(1, "http://h", page), (2, "http://h", page), (3, None, "")], "page_id long, url string, html string")).collect()
    assert {(r.page_id, r.payload_bytes, r.refers_to) for r in got} == {(1, len(page.encode()), None), (2, len(page.encode()), 1), (3, 0, None)}


def test_warc_transactions_nest_their_records(spark):
    pages = spark.createDataFrame([(k, f"http://h/{k}", "p" * (k % 3 * 80)) for k in range(30)], "page_id long, url string, html string")
    records = warc.read_archives(warc.write_archives(pages))
    found = warc.assemble(records).collect()
    assert len(found) == 30
    for r in found:
        assert r.request.target_uri == r.response.target_uri and len(r.metadata) == 1
        assert r.request.payload is not None


# 2 --------------------------------------------------------------------------------------------


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.identify(docs, per_language=1200, per_document=4).join(docs.select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out and lang is not null and lang_pred != 'und'").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert held > 0.9


def test_language_edges(spark, docs, texts, empty):
    found = langid.identify(docs, per_language=50, per_document=2).collect()
    assert len(found) == len(texts)
    for r in found:
        assert 0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if r.doc_id in (100, 101, 102, 113):
            assert r.lang_pred == "und"
    assert langid.identify(empty).count() == 0
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).filter("lang_pred != 'und'").count() == 0
    model = langid.fit(docs, 50, 2)
    assert langid.in_language(docs, model, 0.0).columns == docs.columns
    assert langid.predict(docs, model).columns.count("lang_pred") == 1


def test_a_letter_has_category_l(spark):
    some = [(1, "½ ² Ⅷ", "en", "s"), (2, "12 _ -", "fr", "s"), (3, "語", "en", "s"), (5, "ª", "fr", "s"), *((k, f"the river {k}" if k % 2 else f"la maison {k}", ("fr", "en", "rare")[k % 2 if k > 12 else 2], "s") for k in range(10, 60))]
    found = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, some)).collect()}
    assert found[1] == found[2] == "und" and "und" not in (found[3], found[5])
    assert "rare" in langid.fit(frame(spark, some)).languages


# 3 and 10 ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def awkward(n=300):
    rng = random.Random(11)
    bits = ["a", "ab", " ", "  ", "\n", "\t", ".", ",", "..", "'s", "'ll", "12", "7", "é", "日本", "\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "😀", "_", "-", "X", "The", "\x00", "\x0b", " ", " ", "<|endoftext|>", "aaaaa", "!?", "é"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_token_counts_equal_the_library(spark, docs, texts, empty, library):
    def want(t):
        return len(library.encode(t or "", add_special_tokens=False).ids)

    got = rows(tokencount.count_tokens(docs, tokenizer_path()))
    assert got == sorted(((i, len((t or "").encode()), want(t), want(t) > 512) for i, t, *_ in texts), key=repr)
    assert tokencount.count_tokens(empty, tokenizer_path()).count() == 0
    merger = tokencount.Merger(tokenizer_path())
    some = awkward()
    assert merger(pa.array(some)).tolist() == [want(t) for t in some]
    merger.table.clear()
    assert merger(pa.array(some[::-1])).tolist() == [want(t) for t in some[::-1]]


def test_parts_start_rows_and_repeat(library):
    some = awkward(2000)
    data, bounds = flat(pa.array(some))
    start, parts = chunks.cut(data, bounds)
    assert set(bounds[:-1][np.diff(bounds) > 0]) <= set(start) and len(parts) == len(some) + 1
    encode = tokenout.Encoder(tokenizer_path())
    ids, at = encode(pa.array(some))
    for k, t in enumerate(some):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_token_files(spark, docs, texts, empty, library):
    got = tokenout.token_output(docs, tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    got.sort(key=lambda r: r.start)
    def bytes_of(t):
        return np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u2").tobytes()

    order = sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, bytes_of(r[1])))
    at = 0
    assert len(got) == len(order)
    for r, (i, t, *_) in zip(got, order):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokenout.token_output(empty, tokenizer_path()).count() == 0


def test_token_file_reads_single_documents_and_finds_damage(tmp_path, library):
    encode = tokenout.Encoder(tokenizer_path())
    some = awkward(40)
    ids, at = encode(pa.array(some))
    uri = f"file://{tmp_path}/x.tok"
    tokenout.write_file(uri, [(k, ids[at[k] : at[k + 1]].tobytes()) for k in range(len(some))], encode.kind.itemsize)
    (r, ids), = tokenout.Reader(uri).documents(np.array([17]))
    assert r == 17 and ids.tolist() == library.encode(some[17], add_special_tokens=False).ids
    raw = bytearray((tmp_path / "x.tok").read_bytes())
    raw[20] ^= 255
    (tmp_path / "x.tok").write_bytes(raw)
    with pytest.raises(Exception):
        list(tokenout.Reader(uri).documents())


# 4 --------------------------------------------------------------------------------------------


def shingles(t, size):
    w = WORD.findall(lower(t or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def near_brute(texts, percent, size):
    sets = [shingles(t, size) for _, t, *_ in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if texts[a][0] is None or texts[b][0] is None or not sets[a] or not sets[b]:
                continue
            inter = len(sets[a] & sets[b])
            if 100 * inter >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for k, (i, *_) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(least[find(k)], i)
    out = []
    for k, (i, *_) in enumerate(texts):
        c = None if i is None else least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(spark, docs, texts, empty, size):
    assert rows(neardup.near_duplicates(docs, 80, size)) == near_brute(texts, 80, size)
    assert neardup.near_duplicates(empty, 80, size).count() == 0


def test_near_duplicate_chains_and_hot_groups(spark):
    rng = random.Random(5)
    some, k = [], 0
    for _ in range(6):
        t = prose(rng, 120).split()
        for _ in range(12):  # each differs a little from the one before it
            some.append((k, " ".join(t), None, None))
            k += 1
            for _ in range(rng.randrange(1, 7)):
                t[rng.randrange(len(t))] = f"w{rng.randrange(10**6)}"
    hot = prose(rng, 60)
    some += [(1000 + j, hot, None, None) for j in range(50)]
    rng.shuffle(some)
    assert rows(neardup.near_duplicates(frame(spark, some), 80, 2)) == near_brute(some, 80, 2)


def test_near_duplicates_link_every_text_of_a_doc_id(spark):
    rng = random.Random(21)
    x, y = prose(rng, 90), prose(rng, 90)
    near = [" ".join([*t.split()[:-1], "other"]) for t in (x, y)]
    some = [(1, x, None, None), (1, y, None, None), (2, near[0], None, None), (3, near[1], None, None), (5, "a b c d e f g", None, None), (4, "a b c d e f h", None, None)]
    assert rows(neardup.near_duplicates(frame(spark, some), 80, 2)) == near_brute(some, 80, 2)


def test_near_duplicates_of_boilerplate_families(spark, monkeypatch):
    """Texts that share most of a form collide in many bands without being linked to its middle."""
    monkeypatch.setattr(neardup, "CELL_ROWS", 16)
    rng = random.Random(22)
    form = prose(rng, 100).split()
    some = []
    for k in range(90):
        t = list(form)
        for _ in range(rng.randrange(4, 16)):
            t[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        some.append((k, " ".join(t), None, None))
    assert rows(neardup.near_duplicates(frame(spark, some), 80, 2)) == near_brute(some, 80, 2)


def test_a_pair_of_a_large_family_is_compared_in_one_bucket(spark, monkeypatch):
    """Two texts of 0.75 in common share some ten buckets and are not linked."""
    monkeypatch.setattr(neardup, "CELL_ROWS", 1)
    tables, store = {}, neardup.stored
    monkeypatch.setattr(neardup, "stored", lambda df, kind="table": tables.setdefault(kind, []).append(store(df, kind)) or tables[kind][-1])
    one = [f"w{k}" for k in range(400)]
    two = one[:343] + [f"x{k}" for k in range(57)]
    got = neardup.near_duplicates(spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")).collect()
    assert all(r.kept for r in got) and tables["open"][0].select("band").distinct().count() > 2
    assert tables["chosen"][0].count() == 2


def written(spark):
    """Records and bytes that all stages so far have shuffled."""
    jvm = spark.sparkContext._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    some = [stages.apply(k) for k in range(stages.size())]
    return sum(x.shuffleWriteRecords() for x in some), sum(x.shuffleWriteBytes() for x in some)


def test_near_duplicates_shuffle_bands_once_and_few_texts(spark):
    """Of 400 texts two are alike: the others' texts stay where they are."""
    rng = random.Random(23)
    texts = [(k, "".join(rng.choice("abcdefghijklmnop ") for _ in range(6000)), None, None) for k in range(400)]
    texts.append((400, texts[7][1] + " end", None, None))
    some = frame(spark, texts).cache()
    some.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = written(spark)
        gone = [r.doc_id for r in neardup.near_duplicates(some, 80, 2).filter("not kept").collect()]
        records, size = (x - y for x, y in zip(written(spark), before))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        some.unpersist()
    assert gone == [400]
    assert 32 * 401 <= records < 60 * 401, records
    assert 0 < size < 401 * 6000 / 2, size


def test_likely_keeps_every_wanted_row(spark, monkeypatch):
    texts = spark.range(-3000, 3000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    for bits in (1, 7, 40_000, 1 << 26):
        monkeypatch.setattr(neardup, "MAP_BITS", bits)
        found = {r.doc_id for r in neardup.likely(texts, texts.filter("doc_id % 10 = 0").select("doc_id")).collect()}
        assert found >= set(range(-3000, 3000, 10)) and (bits < 40_000 or len(found) < 1800)
    assert neardup.likely(texts, texts.filter("false").select("doc_id")).count() == 0


def test_near_duplicates_shuffle_full_sets_twice(spark):
    """Once to their class and once to the star that they are compared in, at every size."""
    rng = random.Random(24)
    texts = []
    for k in range(60):
        t = [f"w{rng.randrange(10**9)}" for _ in range(3000)]
        texts += [(2 * k, " ".join(t), None, None), (2 * k + 1, " ".join([*t[:-9], "end"]), None, None)]
    some = frame(spark, texts).cache()
    some.count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        before = written(spark)
        gone = sorted(r.doc_id for r in neardup.near_duplicates(some, 80, 2).filter("not kept").collect())
        size = written(spark)[1] - before[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        some.unpersist()
    assert gone == list(range(1, 120, 2))
    assert 0 < size < 2.7 * 120 * 3000 * 8, size


def test_near_duplicate_stars_are_cut(spark, monkeypatch):
    """A form with many variants, in parts of three around its hub."""
    monkeypatch.setattr(neardup, "STAR_ROWS", 3)
    rng = random.Random(25)
    form = prose(rng, 120).split()
    some = [(k, " ".join([*form[:k], f"x{k}", *form[k + 1 + k % 9 :]]), None, None) for k in range(70)]
    assert rows(neardup.near_duplicates(frame(spark, some), 80, 2)) == near_brute(some, 80, 2)


def test_near_duplicate_cells_are_cut_by_shingles(spark, monkeypatch):
    """Long documents of one family, of which some are linked: cells hold few of them."""
    rng = random.Random(5)
    common = prose(rng, 1500).split()
    texts = [(i, " ".join([*common[: 1100 + 37 * (i % 6)], *prose(rng, 60 * (i % 5) + 1).split()]), None, None) for i in range(60)]
    monkeypatch.setattr(neardup, "CELL_SHINGLES", 6000)
    made = neardup._by_cell

    def measured(batches):
        for t in made(batches):
            if "members" in t.column_names:
                asks = t.column("asks").to_pylist()
                sizes = [len(x.as_buffer()) // 8 for x in t.column("members")]
                assert max(sum(n for n, q in zip(sizes, asks) if q == side) for side in (True, False)) < 4 * 6000
            yield t

    monkeypatch.setattr(neardup, "_by_cell", measured)
    assert rows(neardup.near_duplicates(frame(spark, texts), 80, 2)) == near_brute(texts, 80, 2)


def test_near_duplicates_leave_columns(spark, docs, texts):
    kept = neardup.without_copies(docs, 80, 5)
    assert kept.columns == docs.columns
    gone = {i for i, _, c, k in near_brute(texts, 80, 5) if not k}
    assert rows(kept.select("doc_id")) == sorted(((i,) for i, *_ in texts if i not in gone), key=repr)


def test_hyperminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    pool = np.sort(rng.integers(0, 2**63, 6000, dtype=np.uint64) * np.uint64(2))
    a, b = pool[:5000], pool[1000:]
    regs = neardup.registers(np.concatenate([a, b]), np.array([0, 5000, 10000]))
    n = np.array([5000.0])
    assert abs(neardup.estimate(regs[:1], regs[1:], n, n)[0] - 4000 / 6000) < 0.15


@pytest.mark.parametrize("run", [lambda d: neardup.near_duplicates(d), lambda d: tokenout.encoded(d, tokenizer_path()), lambda d: decontam.tile(d, d.selectExpr("doc_id item_id", "text"))], ids=["near", "ids", "tiles"])
def test_batches_of_long_texts_are_bounded_by_bytes(spark, run):
    """40 MB of long texts, few enough rows for one batch; a bound that the session has is kept."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"])

    long = spark.range(0, 400, 1, 1).selectExpr("id doc_id", "repeat('word ', 20000) text")
    spark.conf.unset(name)
    try:
        run(long.limit(1))
        got = [r.n for r in long.mapInArrow(sizes, "n long").collect()]
        assert sum(got) >= 40_000_000 and max(got) < 5_000_000, max(got)
        spark.conf.set(name, "1000000")
        run(long.limit(1))
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.unset(name)


# 5 --------------------------------------------------------------------------------------------


def repeats_brute(texts, length):
    data = [(t or "").encode() for _, t, *_ in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for (i, *_), d in zip(texts, data):
        gone = bytearray(len(d))
        for p in range(len(d) - length + 1):
            if count[d[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def shared_words_brute(texts, run):
    every = [WORD.findall(lower(t or "")) for _, t, *_ in texts]
    where = defaultdict(set)
    for (_, t, *_), w in zip(texts, every):
        for i in range(len(w) - run + 1):
            where[tuple(w[i : i + run])].add(t)
    out = []
    for (i, *_), w in zip(texts, every):
        hit = {i + k for i in range(len(w) - run + 1) if len(where[tuple(w[i : i + run])]) > 1 for k in range(run)}
        out.append((i, len(hit)))
    return sorted(out, key=repr)


BYTES = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_suffix_dedup(spark, docs, texts, empty):
    found = suffixdedup.remove_repeats(docs)
    assert rows(found.select(BYTES)) == repeats_brute(texts, 400)
    assert rows(found.select("doc_id", "n_shared_words")) == shared_words_brute(texts, 50)
    assert suffixdedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_passages(spark):
    rng = random.Random(8)
    shared = [prose(rng, 70) for _ in range(4)]
    some = []
    for k in range(40):
        t = prose(rng, 60)
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            t += p[rng.randrange(30) : len(p) - rng.randrange(30)] + prose(rng, rng.randrange(50))
        some.append((k, t, None, None))
    some += [(50, "ab" * 400, None, None), (51, "x" * 399, None, None), (52, "x" * 400, None, None), (53, "x" * 401, None, None), (54, "ü" * 300, None, None)]
    some += [(60 + k, prose(rng, 20) + "\n" + shared[0][:330].upper() + "  " + prose(rng, 20), None, None) for k in range(3)]
    found = suffixdedup.remove_repeats(frame(spark, some))
    assert rows(found.select(BYTES)) == repeats_brute(some, 400)
    assert rows(found.select("doc_id", "n_shared_words")) == shared_words_brute(some, 50)


@pytest.mark.parametrize("group", [4])
def test_suffix_dedup_splits_hot_anchors(spark, monkeypatch, group):
    """One passage that many texts share in whole or in part, with little room in one task."""
    monkeypatch.setattr(suffixdedup, "GROUP", group)
    rng = random.Random(18)
    passage, some = prose(rng, 90), []
    for k in range(30):
        a, b = rng.choice([(0, len(passage)), (rng.randrange(200), len(passage)), (0, len(passage) - rng.randrange(200)), (100, 100 + rng.choice([390, 399, 400, 401, 420]))])
        some.append((k, ("" if k % 7 == 0 else prose(rng, rng.randrange(1, 40))) + passage[a:b] + ("" if k % 5 == 0 else prose(rng, rng.randrange(1, 40))), None, None))
    some += [(40, "ab" * 300, None, None), (41, "ab" * 250 + "c", None, None), (42, passage * 2, None, None)]
    assert rows(suffixdedup.remove_repeats(frame(spark, some)).select(BYTES)) == repeats_brute(some, 400)


def test_suffix_dedup_halves_a_row_once_a_level(spark, monkeypatch):
    """The rows of a level are read for the sizes of groups, for the small groups, and to be halved."""
    monkeypatch.setattr(suffixdedup, "GROUP", 4)
    read, store, made = spark.sparkContext.accumulator(0), suffixdedup.stored, []

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    def counted(df, kind="table"):
        out = store(df, kind)
        if kind != "kinds" or made:
            return out
        made.append(out.count())
        seen = out.mapInArrow(count, out.schema)
        seen.stored_path = out.stored_path
        return seen

    monkeypatch.setattr(suffixdedup, "stored", counted)
    rng = random.Random(19)
    passage = prose(rng, 90)
    some = [(k, prose(rng, rng.randrange(1, 40)) + passage + prose(rng, rng.randrange(1, 40)), None, None) for k in range(30)]
    assert rows(suffixdedup.remove_repeats(frame(spark, some)).select(BYTES)) == repeats_brute(some, 400)
    assert made[0] > 30 and read.value <= 3 * made[0]


def test_suffix_dedup_keeps_one_row_for_each_repeated_row(spark):
    rng = random.Random(15)
    shared = prose(rng, 75)
    same, lone = prose(rng, 60) + shared, shared + prose(rng, 50)
    some = [(1, same, None, None), (1, same, None, None), (2, prose(rng, 40) + shared, None, None), (None, lone, None, None), (None, lone, None, None), (None, lone, None, None)]
    assert rows(suffixdedup.remove_repeats(frame(spark, some)).select(BYTES)) == repeats_brute(some, 400)


def test_deep_shallow_sorts():
    rng = random.Random(1)
    stem = bytes(rng.randrange(2) for _ in range(200))
    values = [stem[: rng.randrange(150, 200)] + bytes(rng.randrange(1, 4) for _ in range(rng.randrange(40))) for _ in range(200)]
    r, sizes = suffixdedup._padded(values, 240)
    got = [values[i] for i in suffixdedup.deep_shallow(r, sizes)]
    assert got == sorted(values)


# 6 --------------------------------------------------------------------------------------------


def test_mixing(spark, docs, texts, empty):
    found = mixing.with_copies(docs, repetition=1.5)
    assert found.count() == len(texts) and found.columns.count("mix_copies") == 1
    per = found.groupBy("source").agg(F.sum("mix_tokens").alias("n"), F.sum(F.col("mix_tokens") * F.col("mix_copies")).alias("used"), F.first("mix_epochs").alias("e"), F.first("mix_weight").alias("w"), F.min("mix_copies").alias("least"), F.max("mix_tokens").alias("big"), F.first("mix_exponent").alias("a")).collect()
    total = sum(r.n for r in per)
    z = sum((r.n / total) ** r.a for r in per)
    assert abs(sum(r.w for r in per) - 1) < 1e-9
    for r in per:
        assert abs(r.w - (r.n / total) ** r.a / z) < 1e-9
        assert 1 <= r.e <= 1.5 + 1e-6 and r.least >= 1
        assert r.e * r.n - r.big - 1 <= r.used <= r.e * r.n + 1e-6
    mixed = mixing.mix(docs, repetition=1.5)
    assert mixed.columns == docs.columns and mixed.count() == found.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mix(empty).count() == 0


def test_mixing_realises_its_permutation(spark, docs, texts):
    """Copies by brute force from the positions: whole epochs, then the permutation until the
    tokens left are spent."""
    found = mixing.with_copies(docs, repetition=1.5).collect()
    by = defaultdict(list)
    for r in found:
        by[r.source].append(r)
    for some in by.values():
        some.sort(key=lambda r: r.mix_position)
        assert [r.mix_position for r in some] == list(range(1, len(some) + 1))
        ranks = [r.mix_block_rank for r in some]
        assert ranks == sorted(ranks)
        left = math.floor(round((some[0].mix_epochs - math.floor(some[0].mix_epochs)) * sum(r.mix_tokens for r in some), 6))
        spent, want, at = 0, [], 0
        while at < len(some):
            to = next((k for k in range(at, len(some)) if some[k].doc_id != some[at].doc_id), len(some))
            n = sum(r.mix_tokens for r in some[at:to])
            want += [math.floor(some[0].mix_epochs) + (left > 0 and spent + n <= left)] * (to - at)
            spent = spent + n if spent + n <= left else math.inf
            at = to
        assert [r.mix_copies for r in some] == want
    order = mixing.sequence(docs, repetition=1.5)
    got = order.collect()
    assert order.columns == [*docs.columns, "mix_epoch", "mix_place"]
    assert len(got) == sum(r.mix_copies for r in found)
    assert [(r.mix_epoch, r.mix_place) for r in got] == sorted((r.mix_epoch, r.mix_place) for r in got)


def test_mixing_entropy_and_budget(spark):
    some = [(k, "w " * (1 + k % 7), None, "big" if k % 10 else "small") for k in range(500)]
    d = frame(spark, some)
    a = mixing.exponent(mixing.shares(d.select("source", F.lit(3).alias("n_tokens"))), None, 0.8)
    p = np.array([0.9, 0.1]) ** a
    p /= p.sum()
    assert abs(-(p * np.log(p)).sum() / math.log(2) - 0.8) < 1e-3
    used = mixing.with_copies(d, None, 1.0, budget_tokens=700).agg(F.sum(F.col("mix_tokens") * F.col("mix_copies"))).first()[0]
    assert 700 - 16 <= used <= 700


# 7 --------------------------------------------------------------------------------------------


def test_language_model(spark, docs, texts, empty):
    def tokens(t):
        return [*WORD.findall(lower(t or "")), None]

    out = {k: i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for k, (i, *_) in enumerate(texts)}
    c = Counter(w for k, (_, t, *_) in enumerate(texts) if not out[k] for w in tokens(t))
    total, v = sum(c.values()), len(c)
    want = []
    for k, (i, t, *_) in enumerate(texts):
        w = tokens(t)
        want.append((i, out[k], len(w), sum(c[x] > 0 for x in w), total, round(sum(math.log10((c[x] + 0.5) / (total + 0.5 * (v + 1))) for x in w), 6)))
    got = lm.score_texts(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert all(r.score < 0 for r in got)
    assert lm.score_texts(empty).count() == 0


def test_words_that_are_rare_in_each_block_are_counted(spark):
    """"thin" stands once in each of four blocks of 140,000 tokens, "burst" three times in one."""
    made = spark.range(0, 4, 1, 4).selectExpr("cast(null as long) doc_id", "concat(repeat('all ', 140000), 'thin ', if(id = 2, 'burst burst burst', '')) text")
    tokenised = lm.blocks(made).cache()
    assert tokenised.count() == 4
    own = lm.frequent(tokenised, 2).tolist()
    w = words(*flat(pa.array(["all thin"], pa.string())))
    assert own == sorted(w.hash.tolist())


def test_language_model_is_normalised_and_better_than_a_unigram(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tokenised = lm.stored(lm.blocks(docs), "blocks")
    own = lm.frequent(tokenised)
    model, states = lm.learn(tokenised, own, 4)
    k = len(own) + 2
    found = [lm.Piece(r.words, r.seats, states, k) for r in model.collect()]
    assert len(own) == lm.CONTEXTS and sum(len(x.words) for x in found) == states[-1]["words"]
    for c in (lm.START, lm.OTHER, 2, 17, k - 1):
        known = sum((10 ** x.answer(x.words, np.ones(len(x.words), int), np.full(len(x.words), c))[0]).sum() for x in found)
        none = 10 ** found[0].answer(np.array([12345], np.uint64), np.ones(1, int), np.array([c]))[0][0]
        assert abs(known + none - 1) < 1e-3
    sizes = np.arange(1, 400)
    assert abs((10 ** (lm.spelling(sizes) + sizes * math.log10(250))).sum() - 1) < 1e-6
    scored = lm.score_texts(docs).cache()
    # texts of known words alone: the base is a smoothed unigram of the same words
    known = scored.filter("held_out and n_known = n_tokens").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert known[2] > 5 and known[0] > known[1]


def gibbs_brute(train, test, own, sweeps=400, burn=100, seed=1):
    """One customer after another in the published way: every table of every restaurant by itself."""
    rng = random.Random(seed)
    (d0, d1), (s0, s1) = lm.DISCOUNT, lm.STRENGTH
    seats = [(c, w) for t in train for c, w in zip([None, *t[:-1]], t)]
    context = lambda c: c if c is None or c in own else "other"
    v = len({w for _, w in seats})
    tables, top, n, at = defaultdict(lambda: defaultdict(list)), defaultdict(list), Counter(), [None] * len(seats)

    def up(w):
        total, all_tables = sum(map(sum, top.values())), sum(map(len, top.values()))
        return (max(sum(top[w]) - d1 * len(top[w]), 0) + (s1 + d1 * all_tables) / (v + 1)) / (s1 + total)

    def pick(weights):
        x = rng.random() * sum(weights)
        for i, y in enumerate(weights):
            x -= y
            if x < 0:
                return i
        return len(weights) - 1

    def add_up(w):
        i = pick([*(max(z - d1, 0) for z in top[w]), (s1 + d1 * sum(map(len, top.values()))) / (v + 1)])
        if i == len(top[w]):
            top[w].append(0)
        top[w][i] += 1

    def drop_up(w):
        i = pick(top[w])
        top[w][i] -= 1
        if not top[w][i]:
            del top[w][i]

    score = [0.0] * len(test)
    for sweep in range(sweeps):
        for k, (c, w) in enumerate(seats):
            c = context(c)
            here = tables[c]
            if at[k]:
                i = pick(here[w])
                here[w][i] -= 1
                n[c] -= 1
                if not here[w][i]:
                    del here[w][i]
                    drop_up(w)
            at[k] = True
            i = pick([*(max(z - d0, 0) for z in here[w]), (s0 + d0 * sum(map(len, here.values()))) * up(w)])
            if i == len(here[w]):
                here[w].append(0)
                add_up(w)
            here[w][i] += 1
            n[c] += 1
        if sweep >= burn and sweep % 20 == 0:
            for j, t in enumerate(test):
                for c, w in zip([None, *t[:-1]], t):
                    c = context(c)
                    here = tables[c]
                    p = (max(sum(here[w]) - d0 * len(here[w]), 0) + (s0 + d0 * sum(map(len, here.values()))) * up(w)) / (s0 + n[c])
                    score[j] += math.log10(p)
    return [x / len(range(burn, sweeps, 20)) for x in score]


def test_language_model_agrees_with_single_customers(spark, monkeypatch):
    monkeypatch.setattr(lm, "CONTEXTS", 6)
    rng = random.Random(44)
    vocabulary = [f"w{k}" for k in range(40)]

    def text():
        t = [rng.choice(vocabulary[:8])]
        while len(t) < 14:
            t.append(vocabulary[(vocabulary.index(t[-1]) * 3 + rng.choice([0, 0, 0, 1, 5])) % 40] if rng.random() < 0.8 else rng.choice(vocabulary))
        return t

    out = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 1][:12]
    learnt = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1][:40]
    texts = {i: text() for i in out + learnt}
    tokenised = lm.stored(lm.blocks(frame(spark, [(i, " ".join(t), None, None) for i, t in texts.items()])), "blocks")
    chosen = set(lm.frequent(tokenised, 6).tolist())
    w = words(*flat(pa.array(vocabulary)))
    own = {x for x, h in zip(vocabulary, w.hash.tolist()) if h in chosen}
    assert len(own) == 6
    want = gibbs_brute([[*texts[i], "end"] for i in learnt], [[*texts[i], "end"] for i in out], own)
    monkeypatch.setattr(lm.frequent, "__defaults__", (6,))
    got = {r.doc_id: r.score for r in lm.score_texts(frame(spark, [(i, " ".join(t), None, None) for i, t in texts.items()]), burn_in=20, sweeps=lm.SWEEPS).collect()}
    for i, x in zip(out, want):
        assert abs(got[i] - x) < 0.04 * abs(x)


def test_language_model_scores_unknown_words_below_known_ones(spark):
    out = [i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 5 == 1][:10]
    rng = random.Random(12)
    junk = [(i, " ".join("".join(rng.choices("bcdfghjkxz0189", k=11)) for _ in range(80)), None, None) for i in out[:4]]
    junk.append((out[4], " ".join("шчцж" + "".join(rng.choices("абвг", k=7)) for _ in range(80)), None, None))
    clean = [(i, prose(rng, 80), None, None) for i in out[5:]]
    learnt = [(i, prose(rng, 400), None, None) for i in range(200)]
    got = {r.doc_id: r for r in lm.score_texts(frame(spark, learnt + junk + clean)).collect()}
    assert all(got[i].held_out for i in out)
    mean = {i: got[i].score / got[i].n_tokens for i in out}
    assert max(mean[i] for i, *_ in junk) < min(mean[i] for i, *_ in clean)
    known = [r for r in got.values() if r.held_out and r.n_known == r.n_tokens]
    # words drawn without any order: contexts say nothing, and cost next to nothing
    assert known and sum(r.score for r in known) > 1.01 * sum(r.base_score for r in known)


# 8 --------------------------------------------------------------------------------------------


def tiling_brute(doc, item, least):
    """Greedy string tiling as published: all longest matches first, by place in the item, then the document."""
    md, mi, found = set(), set(), 0
    while True:
        best, at = least, []
        for p in range(len(item)):
            for q in range(len(doc)):
                n = 0
                while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n] and p + n not in mi and q + n not in md:
                    n += 1
                if n > best:
                    best, at = n, [(p, q)]
                elif n == best:
                    at.append((p, q))
        if not at:
            return found
        for p, q in at:
            if not (mi & set(range(p, p + best)) or md & set(range(q, q + best))):
                mi |= set(range(p, p + best))
                md |= set(range(q, q + best))
                found += best


def test_tiles_equal_brute_force():
    rng = random.Random(4)
    for _ in range(40):
        doc = np.array([rng.randrange(4) for _ in range(rng.randrange(5, 50))], np.uint64)
        item = np.array([rng.randrange(4) for _ in range(rng.randrange(5, 30))], np.uint64)
        for least in (3, 5):
            assert sum(n for *_, n in decontam.tiles(doc, item, least)) == tiling_brute(doc.tolist(), item.tolist(), least)


def test_tiles_of_repetitive_texts_stay_small():
    doc, item = np.full(20_000, 7, np.uint64), np.full(2000, 7, np.uint64)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert decontam.tiles(doc, item) == [(0, 0, 2000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000  # kB


def test_decontamination_in_blocks(spark, monkeypatch):
    rng = random.Random(16)
    items = [prose(rng, 30) for _ in range(40)]
    some = [(k, prose(rng, 20) + " " + items[k % 40] + " " + items[(k * 7) % 40], None, None) for k in range(60)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    whole = rows(decontam.tile(frame(spark, some), bench).select("doc_id", "hit_items", "best_item", "coverage", "n_tiles"))
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 700)
    assert len(decontam.prepared(bench)) > 5
    assert rows(decontam.tile(frame(spark, some), bench).select("doc_id", "hit_items", "best_item", "coverage", "n_tiles")) == whole
    assert all(set(r[1]) == {r[0] % 40, r[0] * 7 % 40} for r in whole)


def test_decontamination(spark, docs, texts, empty):
    rng = random.Random(6)
    items = [prose(rng, 40) for _ in range(6)]
    w = [t.split() for t in items]
    planted = [
        (500, prose(rng, 30) + " " + items[0].upper() + " " + prose(rng, 30), None, None),
        (501, " ".join(w[1][20:] + prose(rng, 10).split() + w[1][:20]), None, None),
        (502, " ".join(w[2][:10]), None, None),
        (503, items[3] + " " + items[4], None, None),
    ]
    bench = spark.createDataFrame([*((k, t, 1) for k, t in enumerate(items)), (90, None, 1), (91, "", 1), (None, "x", 1), (92, items[0], 1), (93, "no such words", 1), (3, items[3], 1)], "item_id long, text string, h int")
    both = frame(spark, [*texts, *planted])
    found = {r.doc_id: r for r in decontam.tile(both, bench).filter("doc_id >= 500").collect()}
    assert found[500].hit_items == [0, 92] and found[500].coverage == 1.0
    assert found[501].hit_items == [1] and found[501].n_tiles == 2
    assert found[502].hit_items == [] and found[502].best_item == 2 and found[502].coverage == 0.25
    assert found[503].hit_items == [3, 4]
    clean = decontam.decontaminate(both, bench)
    assert clean.columns == docs.columns
    assert rows(clean.select("doc_id")) == sorted([*((i,) for i, *_ in texts), (502,)], key=repr)
    assert decontam.decontaminate(empty, bench).count() == 0
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)


# 9 --------------------------------------------------------------------------------------------


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    covered = {i + k for p in at.values() if len(p) > 1 for i in p for k in range(8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_quality_statistics(spark, docs, texts, empty):
    rng = random.Random(9)
    line = prose(rng, 12)
    more = [(600 + k, "\n".join(rng.choice([line, "x y", "", "a # b", prose(rng, 9)]) for _ in range(12)), None, None) for k in range(25)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1, None, 0), (None, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    got, _ = quality.quality_filter(frame(spark, [*texts, *more]), labels)
    want = []
    for i, t, *_ in [*texts, *more]:
        s = statistics(t)
        want.append((i, *s, s[0] < 20 or 100 * s[4] > 30 * s[0]))
    assert rows(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == sorted(want, key=repr)
    assert got.filter("kept and base_failed").count() == 0
    assert quality.quality_filter(empty, labels)[0].count() == 0
    assert quality.quality_filter(docs, labels.limit(0))[1] == []


def test_first_condition_has_the_most_gain(spark):
    rng = random.Random(31)
    some = []
    for k in range(600):
        v = {f: round(rng.random(), 3) if f != "symbols_per_word" else (0.0 if rng.random() < 0.8 else round(rng.random(), 2)) for f in quality.FEATURES}
        bad = int(v["symbols_per_word"] > 0.4 or (v["word_length"] < 0.2 and v["repeat_share"] > 0.5))
        some.append((bad, k % 3, *(v[f] for f in quality.FEATURES)))
    d = spark.createDataFrame(some, "bad int, part int, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    cuts = quality.thresholds(d, 32)
    assert len(cuts["symbols_per_word"]) > 10
    grow = [r for r in some if r[1] < 2]
    all_p, all_n = sum(r[0] for r in grow), sum(1 - r[0] for r in grow)

    def gain(f, above, t):
        k = 2 + quality.FEATURES.index(f)
        hit = [r[0] for r in grow if (r[k] > t if above else r[k] <= t)]
        p = sum(hit)
        return p * (math.log2(p / len(hit)) - math.log2(all_p / (all_p + all_n))) if p else -1

    rules = quality.learn(d)
    first = rules[0][0]
    assert gain(first.feature, first.above, first.threshold) == max(gain(f, a, t) for f in quality.FEATURES for a in (True, False) for t in cuts[f])
    got = [r.v for r in d.select(quality.verdict(rules).alias("v")).collect()]
    for row, v in zip(some, got):
        want = next((k for k, rule in enumerate(rules, 1) if all((row[2 + quality.FEATURES.index(c.feature)] > c.threshold) == c.above for c in rule)), 0)
        assert v == want
    assert sum((v > 0) == bool(r[0]) for v, r in zip(got, some)) > 570


def test_decision_list_learns(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    marks = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    found, rules = quality.quality_filter(d, marks)
    joined = found.join(marks, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()
    kept = {r.quality: r.kept for r in joined}
    assert rules and kept[1] > kept[0]
