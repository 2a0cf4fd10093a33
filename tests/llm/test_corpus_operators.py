"""Near-duplicates, quality, mixing, sharding, toxicity and the pipeline against plain versions; odd inputs for all."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st


import corpus_pipeline
from gridspark.llm import bpe, components, html_main, mixing, mpeg, pii, quality, queries, secrets, sharding, simhash, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _s string, bucket long, fp long, _toxicity double, _keep_id long, v int"


def odd_rows():
    long = "very long text " * 20_000
    rows = [(1, "same words here again", "en", "a", 21), (2, "same words here again", "en", "a", 21), (2, "same words here again", "en", "a", 21), (3, None, None, None, None), (4, "", "en", "b", 0), (5, long, "de", "b", len(long)), (None, "no id at all", "en", None, 12), (6, " \t\n\x0b ", "en", "a", 5), (7, "mail me a.b@c.de token = 'abcdef123456'", "en", "c", 3), (8, "ÀÉ 日本 🙂 ₿", "xx", "c", 9)]
    return [(*r, "x", 1, 2, 0.5, 9, 0) for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (5, None), (None, 1)], "doc_id long, toxic int")


def test_every_operator_takes_odd_rows_and_none(spark, odd, none):
    model = toxicity.train(odd, _labels(spark))
    runs = [pii.scanned, secrets.scanned, mpeg.digests, bpe.digests, quality.ledger, simhash.near_duplicates, mixing.mixed, sharding.sharded, lambda df: toxicity.scored(df, model)]
    for run in runs:
        assert run(odd).count() == len(odd_rows())
        assert run(none).count() == 0
    pages = spark.createDataFrame([(1, None, None), (1, "u", ""), (None, "u", "<p>x"), (2, "u", "<article>" + "<p>word" * 30_000)], "page_id long, url string, html string")
    trees = html_main.train(pages)
    got = html_main.main_text(pages, trees).toPandas()
    assert len(got) == 4 and got.n_chars.tolist() == [len(t) for t in got.text]
    assert html_main.main_text(pages.limit(0), html_main.train(pages.limit(0))).count() == 0


def test_pipeline_stages_keep_columns_on_odd_rows(spark, odd, none, tmp_path):
    _labels(spark).write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (odd, none):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, str(tmp_path))
            if name != "bpe":
                assert after.columns == docs.columns, name
            after.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")


def test_equal_texts_give_equal_digests(odd):
    got = mpeg.digests(odd).toPandas().set_index("doc_id")
    assert got.loc[2].drop_duplicates().shape[0] == 1 and (got.loc[2].iloc[0] == got.loc[1]).all()
    row = got.loc[3]
    assert row.n_bytes == 0 and row.payload_bytes == 192 and row.tail_crc32 == zlib.crc32(b" " * 16)


# SimHash.


def plain_fingerprint(text):
    words = text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    k = min(3, len(words))
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    own = list(range(len(fps)))

    def top(k):
        while own[k] != k:
            k = own[k]
        return k

    a = np.array(fps, dtype=np.uint64)
    for k in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[k] ^ a[k + 1 :]) <= 3):
            own[top(k)] = top(k + 1 + int(j))
    return [top(k) for k in range(len(fps))]


def test_fingerprint_equals_the_plain_one():
    for t in ("", "one", "One two", "A b c", "a B c d e f g", "é É ß a\x0bb\x1cc d", " ".join("w%d" % (k % 7) for k in range(500))):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing(spark):
    rng = random.Random(4)
    fps = set()
    for _ in range(300):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(rng.randint(0, 4)):
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(_signed(f),) for f in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df)).collect()}
    got = [roots.get(_signed(f), _signed(f)) for f in fps]
    want = plain_components(fps)
    assert len({*zip(got, want)}) == len(set(got)) == len(set(want))


def test_oversized_buckets_are_dealt_out(spark):
    base, free = 0x123456789ABCDEF0, range(40, 53)
    fps = [base ^ sum(((k >> i) & 1) << b for i, b in enumerate(free)) for k in range(4300)]
    df = spark.createDataFrame([(_signed(f),) for f in fps], "fp long")
    edges = simhash.links(df)
    found = components.components(edges)
    assert found.select("node").distinct().count() == 4300 and found.select("root").distinct().count() == 1
    assert edges.count() < 16 * 4 * 4300


def test_components_of_chains_hubs_and_loops(spark):
    rows = [(k, k + 1) for k in range(40)] + [(1000, k) for k in range(1001, 1300)] + [(5, 5), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(rows, "u long, v long")).collect()}
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(1000, 1300)} == {1000} and got[2001] == 2000 and len(got) == 41 + 300 + 2
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").toPandas()
    got = simhash.near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).toPandas().set_index("doc_id")
    fps = [plain_fingerprint(t) for t in docs.text]
    assert [f"{f:016x}" for f in fps] == got.loc[docs.doc_id].fingerprint.tolist()
    distinct = sorted(set(fps))
    root = dict(zip(distinct, plain_components(distinct)))
    docs["root"] = [root[f] for f in fps]
    assert docs.groupby("root").doc_id.transform("min").tolist() == got.loc[docs.doc_id].component_id.tolist()
    kept = simhash.drop_near_duplicates(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(docs.groupby("root").doc_id.min())


# Quality.


def plain_quality(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[k : k + 5]) for k in range(len(words) - 4))
    covered = {j for k in range(len(words) - 4) if windows[tuple(words[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(covered)


def test_quality_measures_equal_plain_ones(spark):
    rng = random.Random(8)
    docs = ["", "a b c d e", "a a a a a a a", "x\ny\nx\n \n\nx\r\nx"] + [" ".join(rng.choice(["a", "b", "c#", "d\n", " e", "\x1cf", "$%"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    for r in quality.ledger(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(docs[r.doc_id]), docs[r.doc_id]


def test_policies_and_ablation_come_from_the_bits(spark):
    book = quality.ledger(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).cache()
    bits = [r.fail_bits for r in book.select("fail_bits").collect()]
    for version, mask in quality.POLICIES.items():
        assert quality.with_policy(book, version).where("kept").count() == sum(not b & mask for b in bits)
        for r in quality.ablation(book, version).collect():
            bit = quality.BITS[r.rule]
            assert r.n_failed == sum(bool(b & bit) for b in bits)
            assert r.n_only == sum(b & mask == bit for b in bits)
            assert r.n_kept_without == sum(not b & mask & ~bit for b in bits)


# Mixing.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_pfair_period_meets_releases_and_deadlines(tickets):
    total, served = sum(tickets), Counter()
    for slot, i in enumerate(mixing.period(tickets)):
        k = served[i]
        assert k * total // tickets[i] <= slot < -(-(k + 1) * total // tickets[i])
        served[i] += 1
        for j, w in enumerate(tickets):
            assert abs(served[j] - w * (slot + 1) / total) < 1
    assert [served[i] for i in range(len(tickets))] == tickets


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 400), st.integers(1, 9)), min_size=1, max_size=6))
def test_plan_equals_a_slot_by_slot_schedule(sources):
    rows, tickets = [r for r, _ in sources], [t for _, t in sources]
    left = [-(-r // 8) for r in rows]
    done, order, start, own = [0] * len(rows), [], 0, [0] * len(rows)
    while any(left):
        total = sum(t for t, n in zip(tickets, left) if n)
        ready = [(start + -(-(own[i] + 1) * total // tickets[i]), i) for i in range(len(rows)) if left[i] and start + own[i] * total // tickets[i] <= len(order)]
        _, i = min(ready)
        order.append((i, done[i]))
        left[i], done[i], own[i] = left[i] - 1, done[i] + 1, own[i] + 1
        if not left[i]:
            start, own = len(order), [0] * len(rows)
    at = {}
    for i, phases in enumerate(mixing.plan(rows, tickets, 8)):
        for p in phases:
            for b in range(p["lo"], p["hi"]):
                k = b - p["lo"]
                at[p["start"] + k // p["w"] * p["total"] + p["slots"][k % p["w"]]] = (i, b)
    assert [at[s] for s in sorted(at)] == order and sorted(at) == list(range(len(order)))


def test_mixed_places_every_row_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mixed(docs, block_rows=8).toPandas().sort_values("position", ignore_index=True)
    assert got.position.tolist() == list(range(len(got))) and got.doc_id.nunique() == len(got)
    blocks = got.groupby("slot").agg(source=("source", "nunique"), n=("doc_id", "size"))
    assert (blocks.source == 1).all() and (blocks.n <= 8).all()
    for _, part in got.drop_duplicates("slot").groupby("phase"):
        assert ((part.release <= part.slot) & (part.slot < part.deadline)).all()
    ordered = mixing.in_mixed_order(docs, block_rows=8)
    assert ordered.columns == docs.columns and [r.doc_id for r in ordered.select("doc_id").collect()] == got.doc_id.tolist()
    explicit = mixing.mixed(docs, {s: 1 + k for k, s in enumerate(sorted(set(got.source)))}, block_rows=8)
    assert explicit.count() == len(got)


def test_mixed_places_any_number_of_sources(spark, monkeypatch):
    docs = spark.range(9000).selectExpr("id as doc_id", "concat('site', cast(pow(id, 0.8) as int)) as source")
    n = docs.select("source").distinct().count()
    assert n > 1000
    got = mixing.mixed(docs).toPandas().sort_values("position", ignore_index=True)
    assert got.position.tolist() == list(range(9000)) and got.doc_id.nunique() == 9000 and got.source.nunique() == n
    assert ((got.release <= got.slot) & (got.slot < got.deadline)).all()
    few = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = mixing.mixed(few, block_rows=4).toPandas().sort_values("position", ignore_index=True)
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert mixing.mixed(few, block_rows=4).toPandas().sort_values("position", ignore_index=True).equals(want)
    assert mixing.in_mixed_order(few, block_rows=4).select("doc_id").toPandas().doc_id.tolist() == want.doc_id.tolist()


# Sharding.


def test_shards_follow_the_rows_law(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.sharded(docs).toPandas()
    counts = got.groupby("shard").size()
    assert len(got) == 1000 and counts.max() - counts.min() <= 1
    for _, slots in got.groupby("shard").slot:
        assert sorted(slots) == list(range(len(slots)))
    texts = docs.toPandas().set_index("doc_id").text
    assert all(zlib.crc32(texts[i].encode()) == c and s == len(texts[i].encode()) + 1 for i, c, s in zip(got.doc_id, got.text_crc32, got["size"]))
    again = sharding.sharded(docs.repartition(7, "text")).toPandas()
    assert got.sort_values("doc_id", ignore_index=True).equals(again.sort_values("doc_id", ignore_index=True))
    sharding.write_shards(docs, f"{tmp_path}/shards")
    back = spark.read.parquet(f"{tmp_path}/shards").select("doc_id", "text", "shard", "slot").toPandas().merge(got, on="doc_id")
    assert (back.shard_x == back.shard_y).all() and (back.slot_x == back.slot_y).all() and len(back) == 1000
    assert (back.text == texts[back.doc_id].to_numpy()).all()


@given(st.integers(0, 300), st.integers(0, 10))
@settings(max_examples=40, deadline=None)
def test_fisher_yates_is_a_permutation(n, seed):
    p = sharding.fisher_yates(n, seed)
    assert sorted(p.tolist()) == list(range(n)) and (p == sharding.fisher_yates(n, seed)).all()


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, s).tolist()) for s in range(6000))
    assert len(seen) == 6 and min(seen.values()) > 850


# Toxicity.


def test_viterbi_restores_disguised_words():
    words = "idiot clown people nothing reading station thinking letter window silent " * 50
    c = toxicity.letter_classes()[np.frombuffer(f"\n\n{words}\n".encode("utf-32-le"), "<u4")].astype(int)
    counts = np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3)
    channel = toxicity.Channel(counts)
    assert channel.restore("you 1d10t and cl0wn") == "you idiot and clown"
    assert channel.restore("an i d i o t here") == "an idiot here"
    assert "idiot" in channel.restore("such an iiidiooot ok")
    assert channel.restore("Plain words, unchanged!! 42") == "plain words, unchanged!! 42"
    assert channel.restore("") == ""


def test_toxicity_on_the_held_out_fold(spark):
    d = "/root/testdata/sf0.1"
    got = queries.op4_noisy_channel_toxicity(spark, d).toPandas()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    seen = got.merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    seen = seen[seen.held_out]
    assert seen[seen.toxic == 1].predicted.mean() > 0.8 and seen[seen.toxic == 0].predicted.mean() < 0.05


def test_pipeline_end_to_end(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    model = toxicity.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    score = model.scorer()
    clean = docs[[x < toxicity.THRESHOLD for x in score(docs.text.tolist())]]
    fps = [plain_fingerprint(t) for t in clean.text]
    root = dict(zip(sorted(set(fps)), plain_components(sorted(set(fps)))))
    first = clean.assign(root=[root[f] for f in fps]).sort_values("doc_id").drop_duplicates("root")
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(bpe.VOCABULARY)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    want = {i: library.encode_ordinary(pii.redacted(t, pii.find(t))) for i, t in zip(first.doc_id, first.text)}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


# Inputs that lost or corrupted data once.


def test_shards_keep_large_ids_beside_nulls(spark, tmp_path):
    rows = [(2**60 + 1, "a"), (2**60 + 3, "b"), (None, "c"), (None, None), (-(2**63), "d"), (2**63 - 1, "e")] + [(7, "same")] * 500 + [(None, "copy")] * 100
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.sharded(df).collect()
    plain = lambda i, t: (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter(plain(*r) for r in rows)
    assert sorted(r.slot * 8 + r.shard for r in got) == list(range(len(rows)))
    sharding.write_shards(df, f"{tmp_path}/ids")
    back = spark.read.parquet(f"{tmp_path}/ids").collect()
    assert Counter((r.doc_id, r.text) for r in back) == Counter(rows)
    assert sorted(r.slot * 8 + r.shard for r in back) == list(range(len(rows)))
    sharding.write_shards(df.limit(0), f"{tmp_path}/none")
    assert spark.read.schema("doc_id long, text string").parquet(f"{tmp_path}/none").count() == 0


def test_shards_equal_a_plain_two_pass_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = sharding.bucket_count(1000, sum(len(t.encode()) + 1 for t in docs.toPandas().text))
    keyed = docs.selectExpr("doc_id", "text", f"xxhash64({sharding.SEED}, doc_id, crc32(cast(text as binary)), cast(octet_length(text) + 1 as long), 0L) as k").toPandas()
    buckets, order = {}, []
    for r in keyed.sort_values("k").itertuples():
        buckets.setdefault(r.k % n, []).append(r.doc_id)
    for b in sorted(buckets):
        own, rng = buckets[b], np.random.Generator(np.random.PCG64(sharding.SEED + b))
        places = list(range(len(own)))
        swaps = rng.integers(0, np.arange(len(own), 1, -1)).tolist() if len(own) > 1 else []
        for i, j in zip(range(len(own) - 1, 0, -1), swaps):
            places[i], places[j] = places[j], places[i]
        laid = [None] * len(own)
        for x, p in zip(own, places):
            laid[p] = x
        order += laid
    got = {r.slot * 8 + r.shard: r.doc_id for r in sharding.sharded(docs).collect()}
    assert [got[p] for p in range(1000)] == order


def test_near_duplicates_with_repeated_and_missing_ids(spark):
    one, two = "the first text of an id that repeats here", "nothing at all like the other one, really"
    rows = [(1, one, None), (1, two, None), (2, two, "x"), (None, one, None), (None, "alone without any id", None), (None, "alone without any id", None), (9, None, "x"), (9, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _kept_id string")
    for _ in range(2):
        kept = sorted(((r.doc_id, r.text) for r in simhash.drop_near_duplicates(df).collect()), key=str)
        assert kept == sorted([(1, one), (1, two), (None, "alone without any id"), (9, None), (9, "x")], key=str)
        df = df.repartition(5)


def test_mixing_takes_any_column_name_and_null_ids(spark):
    docs = spark.createDataFrame([(k if k % 3 else None, "ab"[k % 2], k, f"t{k}") for k in range(400)], "doc_id long, source string, _position long, text string")
    got = mixing.in_mixed_order(docs, block_rows=4)
    assert got.columns == docs.columns and sorted(r._position for r in got.collect()) == list(range(400))
    assert sorted(r.position for r in mixing.mixed(docs, block_rows=4).collect()) == list(range(400))


def test_hubs_are_split_in_components(spark):
    rows = [(0, k) for k in range(1, 3000)] + [(k, k + 10_000) for k in range(1, 3000)]
    got = components.components(spark.createDataFrame(rows, "u long, v long")).collect()
    assert len(got) == 1 + 2 * 2999 and {r.root for r in got} == {0}


def test_media_digests_equal_plain_hashing(spark):
    texts = [("y" * at + "TAG" + "y" * 400)[:n] for n in (192, 384, 960, 7680) for at in (0, 64, 89, 256, 832, 7552)]
    texts += ["", "ID3" * 70, "Xing" + "z" * 188, "Info", "VBRI" * 300, "é" * 96, "a" * 191, "a" * 193]
    odd_texts = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, None)], "doc_id long, text string")
    for df in (odd_texts, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")):
        source = {r.doc_id: (r.text or "").encode() for r in df.collect()}
        got = mpeg.digests(df).collect()
        assert len(got) == len(source)
        for r in got:
            raw = source[r.doc_id]
            want = raw + b" " * ((192 - len(raw) % 192) % 192 if raw else 192)
            assert (r.n_bytes, r.payload_bytes) == (len(raw), len(want))
            assert r.payload_sha256 == hashlib.sha256(want).hexdigest() and r.tail_crc32 == zlib.crc32(want[-16:])
            assert len(r.seek_offsets.split(",")) == r.n_frames and r.duration_us == r.n_frames * 1152 * 1_000_000 // 48_000


def test_media_column_is_read_by_a_plain_parser(spark):
    df = spark.createDataFrame([(1, "TAG" * 900), (2, None), (3, "x" * 5000)], "doc_id long, text string")
    for r in mpeg.stored(df).collect():
        data, at, offsets, payload = r.media, 10 + sum((b & 127) << s for b, s in zip(r.media[6:10], (21, 14, 7, 0))), [], b""
        while at < len(data):  # every header in place, none searched for
            assert data[at] == 255 and data[at + 1] == 0xFA and data[at + 2] & 12 == 4
            kbit = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)[data[at + 2] >> 4]
            offsets.append(at)
            payload += data[at + 23 : at + 3 * kbit] if len(offsets) > 1 else b""
            at += 3 * kbit
        assert at == len(data) and offsets[1:] == r.seek_offsets and r.n_samples == 1152 * len(r.seek_offsets)
        assert mpeg.demux(data).payload == payload[: len(mpeg.demux(data).payload)]
    assert mpeg.stored(df.limit(0)).count() == 0


def test_text_writers_take_no_rows_and_nulls(spark):
    df = spark.createDataFrame([(None, None, None), (1, "a.b@c.de", 8)], "doc_id long, text string, n_chars int")
    assert [tuple(r) for r in pii.redact(df).collect()] == [(None, None, None), (1, "<EMAIL>", 7)]
    model = toxicity.Model(np.zeros(28**3, np.int64), {}, -3.0)
    assert toxicity.without_toxic(df, model).count() == 2
    assert bpe.encoded(df).count() == 2
    for run in (pii.redact, bpe.encoded, lambda d: toxicity.without_toxic(d, model), simhash.drop_near_duplicates):
        assert run(df.limit(0)).count() == 0


def _channel(text):
    c = toxicity.letter_classes()[np.frombuffer(f"\n\n{text}\n".encode("utf-32-le"), "<u4")].astype(int)
    return toxicity.Channel(np.bincount((c[:-2] * 28 + c[1:-1]) * 28 + c[2:], minlength=28**3))


PROSE = "you are an idiot and a clown and it is so stupid that the people here say nothing of the letter i wrote to a friend all well known "


def test_viterbi_restores_mixed_disguises():
    channel = _channel(PROSE * 300)
    for hidden in ("idi07", "id*iot", "i_d_i_o_t", "i.d.i.o.t", "i  d  i  o  t", "iidiot", "i d 1 0 t", "1d1 0 t", "iiidddiiiooottt", "1d*10t"):
        assert channel.restore(f"you {hidden} there") == "you idiot there", hidden
    assert channel.restore("st.upid, st u pid st*u*pid") == "stupid, stupid stupid"
    assert channel.restore("a i d i o t here") == "a idiot here"
    assert channel.restore("It is a well-known letter, 42 of 1990!") == "it is a well-known letter, 42 of 1990!"


def test_viterbi_equals_the_best_of_all_paths():
    channel, rng = _channel(PROSE * 20), random.Random(9)
    table, gap = channel.logp, toxicity.GAP

    def value(path):
        a = b = gap
        total = 0.0
        for x, cost in path:
            total += cost
            if not x:
                continue
            if x.isalpha():
                c = ord(x) - 97 if "a" <= x <= "z" else toxicity.FOREIGN
                total, a, b = total + table[a][b][c], b, c
            else:
                total, a, b = total + (0 if b == gap else table[a][b][gap]), gap, gap
        return total + (0 if b == gap else table[a][b][gap])

    for _ in range(300):
        piece = "".join(rng.choice("idot1 0$*ééll ") for _ in range(rng.randint(1, 8))).strip()
        arcs = channel.arcs(piece)
        best = max(value(p) for p in itertools.product(*arcs))
        got = channel.decode(piece)
        same = [value(p) for p in itertools.product(*arcs) if "".join(x for x, _ in p) == got]
        assert same and abs(max(same) - best) < 1e-9, piece


def _groups(t):
    """Tokens of a text tied by white space that may be nothing, one after another."""
    spans = [m.span() for m in re.finditer(r"\S+", t)]
    out = []
    for a, b in spans:
        if out:
            c, d = out[-1][-1]
            one, two = t[c:d], t[a:b]
            if (len(one) == len(two) == 1) or (len(one) == 1 and one.isalnum()) or (len(two) == 1 and two.isalnum()):
                out[-1].append((a, b))
                continue
        out.append([(a, b)])
    return [(g[0][0], g[-1][1]) for g in out]


def test_stretches_do_not_change_a_reading():
    """The whole lattice of a group of tied tokens, searched at once, against the search by stretches."""
    channel, rng = _channel(PROSE * 20), random.Random(10)
    letter, sign = r"[^\W\d_]", "[" + re.escape("".join(toxicity.SIGNS)) + "]"
    parts = ["idiot", "clown", "letter", "a", " ", " ", "1", "0", "d", "people", "*", "ss", "é", "friend", "  ", "$", "\n", ".", "42", "_", "ñ", "ll"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for t, got in zip(texts, channel.restore_all(texts)):
        want, at = [], 0
        for a, b in _groups(t):
            piece = t[a:b]
            inside = re.search(rf"({letter})\1|{sign}(?={letter})|(?<={letter}){sign}|(?<={letter})(?:[^\w\s]|_)+(?={letter}|{sign})|(?<!\S)[^\W_](?!\S)", piece)
            want += [t[at:a], channel.decode(piece) if inside else piece]
            at = b
        assert got == "".join([*want, t[at:]]), t


def test_scores_equal_a_plain_sum_of_weights():
    channel = _channel(PROSE)
    weights = {b: 0.5 + k for k, b in enumerate(sorted({f for w in ("idiot", "clown", "people") for f in toxicity.features(w)}))}
    counts = np.zeros(28**3, np.int64)
    model = toxicity.Model(counts, weights, -4.0)
    score, plain = model.scorer(), toxicity.Channel(counts)
    for t in ("", "people idiot people", "a clown, a people", "nothing"):
        own = {f for w in toxicity.WORD.findall(plain.restore(t)) for f in toxicity.features(w)} & set(weights)
        assert abs(score([t])[0] - 1 / (1 + np.exp(4.0 - sum(weights[f] for f in own)))) < 1e-12
    assert channel.restore("clown") == "clown"


def test_an_id_of_two_labels_takes_the_higher_one(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} text") for k in range(40)], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(40)] + [(k, 1 - k % 2) for k in range(40)]
    models = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, labels[::-1])]
    assert models[0].weights == models[1].weights and models[0].bias == models[1].bias > 0


def test_scratch_tables_go(spark):
    import os

    from gridspark.llm import common

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    common.release(spark)
    folder = common.shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    kept = common.distilled(spark, lambda: simhash.drop_near_duplicates(docs), "kept")
    assert len(set(os.listdir(folder)) - before) == 1 and kept.count() > 0
    assert simhash.near_duplicates(docs).count() == docs.count()
    common.release(spark)
    assert set(os.listdir(folder)) <= before
