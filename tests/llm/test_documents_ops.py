"""Each document operator against a brute-force version, on odd rows and on an empty table."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id, mixing, quality_rules, sentence_pieces, sharding, simhash_dedup, suffix_dedup, token_counts, toxicity
from ledgerlens.llm.shared import running_sums, tokenizer_path


def ids_and_texts(rows):
    return [(r[0], r[1]) for r in rows]


# ---- 1 token counts


def test_token_histogram(odd, odd_rows, empty):
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(token_counts.VOCABULARY), "rb"))}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = sorted(len(enc.encode_ordinary(t)) if t else 0 for _, t in ids_and_texts(odd_rows))
    hist = token_counts.histogram(odd)
    assert {r["n_tokens"]: r["n_docs"] for r in hist.collect()} == Counter(lengths)
    limits = token_counts.context_limits(hist)
    for r in limits.collect():
        n = r["n_tokens"]
        assert r["docs_within"] == sum(x <= n for x in lengths) and r["docs_longer"] == sum(x > n for x in lengths)
        assert r["tokens_within"] == sum(x for x in lengths if x <= n) and r["tokens_longer"] == sum(x for x in lengths if x > n)
        assert r["truncated_tokens"] == sum(min(x, n) for x in lengths)
    assert token_counts.quantile(limits, 0.5) == lengths[-(-len(lengths) // 2) - 1]
    assert token_counts.truncated_total(hist, 37) == sum(min(x, 37) for x in lengths)
    assert token_counts.context_limits(token_counts.histogram(empty)).count() == 0


def test_running_sums_over_all_levels(spark):
    keys = sorted({(k * 7919) % 5_000_000 for k in range(400)} | {2**40, 2**41 + 3})
    got = running_sums(spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long"), "k", ["v"])
    for r in got.collect():
        assert r["v_before"] == sum(k % 7 for k in keys if k < r["k"])


# ---- 2 quality rules


def brute_measures(text):
    text = text or ""
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def test_quality_measures_and_verdicts(odd, odd_rows, empty):
    got = quality_rules.judge(odd).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = Counter((r[0], *brute_measures(r[1])) for r in odd_rows)
    assert Counter((r["doc_id"], *[r[n] for n in names]) for r in got) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    kept = Counter(r["doc_id"] for r in got if r["kept"])
    assert Counter(r["doc_id"] for r in quality_rules.keep_good(odd).collect()) == kept
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep_good(empty).count() == 0


def test_bad_hosts_take_all_their_documents(spark):
    good = " ".join(f"w{i}" for i in range(20))
    rows = [(k, "too short" if k % 10 else good, "bad") for k in range(200)] + [(1000 + k, good if k % 20 else "short", f"h{k % 5}") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {(r["host"], r["kept"]) for r in quality_rules.judge(docs).filter("not base_failed").collect()}
    assert ("bad", False) in got and ("bad", True) not in got and all((f"h{k}", True) in got for k in range(5))
    assert "bad" not in {r["source"] for r in quality_rules.keep_good(docs).collect()}


def test_repeated_words_with_a_large_vocabulary():
    words = [f"w{i}".encode() for i in range(9000)] * 2
    assert quality_rules.repeated_words(words) == 18000
    assert quality_rules.repeated_words(words[:9003]) == 0


# ---- 4 sharding


def test_shards_are_exact_and_gapless(odd, odd_rows, empty):
    got = sharding.shuffle_into_shards(odd, 4).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter(ids_and_texts(odd_rows))
    assert sharding.shuffle_into_shards(empty, 4).count() == 0


def test_communication_matrix_is_hypergeometric():
    totals = np.zeros((3, 4))
    for seed in range(300):
        m = sharding.communication_matrix([10, 0, 31], 4, seed)
        assert m.sum(axis=1).tolist() == [10, 0, 31] and sorted(m.sum(axis=0).tolist()) == [10, 10, 10, 11]
        totals += m
    assert np.abs(totals / 300 - np.array([10, 0, 31])[:, None] / 4).max() < 0.5


def test_hypergeometric_law():
    rng = np.random.default_rng(1)
    got = np.bincount([sharding.hypergeometric(rng, 5, 7, 4) for _ in range(20_000)], minlength=5) / 20_000
    from math import comb

    want = [comb(5, k) * comb(7, 4 - k) / comb(12, 4) for k in range(5)]
    assert np.abs(got - want).max() < 0.015
    assert abs(sharding.hypergeometric(rng, 10**12, 10**12, 10**10) - 5 * 10**9) < 10**6


def test_shuffle_is_uniform(spark):
    rows = spark.range(64).withColumnRenamed("id", "doc_id").repartition(3)
    first = Counter()
    for seed in range(12):
        first.update(r["doc_id"] // 16 for r in sharding.shuffle_into_shards(rows, 2, seed).filter("slot < 8").collect())
    assert all(25 < first[k] < 75 for k in range(4)), first


# ---- 5 language


def test_language_of_unseen_and_empty_texts(spark, odd, empty):
    import random

    rng = random.Random(3)
    words = {"en": ["the", "house", "with", "water", "and"], "de": ["das", "haus", "mit", "wasser", "und"], "el": ["το", "σπίτι", "με", "νερό", "και"]}
    rows = [(k, " ".join(rng.choice(w) for _ in range(12)), lang) for k, (lang, w) in enumerate(list(words.items()) * 40)]
    rows += [(900, None, "en"), (901, "12 ² --", "en"), (902, "waters houses", None), (903, "wassers häuser", "xx"), (None, "the water", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert len(got) == len(rows)
    assert all(r["held_out"] == (k is not None and zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items())
    assert all(got[k]["lang_pred"] == lang for k, _, lang in rows if k is not None and k < 900)
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0
    assert got[902]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got.values())
    assert language_id.identify(odd).count() == odd.count() and language_id.identify(empty).count() == 0
    nothing = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert language_id.identify(nothing).first()["lang_pred"] == "und"


# ---- 6 mixing


def brute_targets(sizes):
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = sum(weight[s] for s in sizes if s not in capped)
        if not open_:
            break
        over = {s for s in sizes if s not in capped and rest * weight[s] / open_ > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    return {s: 3 * sizes[s] if s in capped else rest * weight[s] / open_ for s in sizes}


def test_mixture_meets_its_targets(odd, odd_rows, empty):
    import re

    got = mixing.rounded(odd).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += count(r[1])
    targets = brute_targets(sizes)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], count(r[1])) for r in odd_rows)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)
    again = mixing.rounded(odd).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["copies"] for r in got)
    assert mixing.rounded(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_reduction_tree_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 20)
    monkeypatch.setattr(mixing, "FAN_IN", 3)
    docs = spark.createDataFrame([(k, "w " * (1 + k % 17), "abcd"[k % 4]) for k in range(900)], "doc_id long, text string, source string")
    sums = mixing.rounded(docs).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r["n"] for r in sums) == 900 and all(abs(r["taken"] - r["target"]) <= 9 for r in sums), sums


def test_pivot_keeps_words_and_expectation():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b, p, q = rng.integers(1, 50), rng.integers(1, 50), rng.random() * 0.98 + 0.01, rng.random() * 0.98 + 0.01
        results = [mixing.pivot(a, p, b, q, u) for u in (np.arange(2000) + 0.5) / 2000]
        assert all(abs(x * a + y * b - p * a - q * b) < 1e-6 and (x in (0, 1) or y in (0, 1)) and -1e-9 <= min(x, y) and max(x, y) <= 1 + 1e-9 for x, y in results)
        assert abs(np.mean([x for x, _ in results]) - p) < 0.01


# ---- 7 suffix array


def brute_repeats(rows):
    """Per row of (key, bytes) in order: n_bytes, n_removed, n_spans, sha256 of what is left."""
    seen, out = set(), []
    for b in rows:
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\x01" * 100
            seen.add(w)
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        out.append((len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize("records, part", [(600_000, 16 << 20), (60, 20_000)])
def test_repeats_are_found_exactly(spark, odd_rows, monkeypatch, records, part):
    for name in ("SIEVE_RECORDS", "BUCKET_SUFFIXES", "BUCKET_STRINGS"):
        monkeypatch.setattr(suffix_dedup, name, records)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", part)
    rows = [r for r in odd_rows if r[0] != 11 and r[0] is not None]  # equal ids with different texts have an order of their own
    from tests.llm.conftest import SCHEMA

    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = suffix_dedup.remove_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    ordered = sorted(rows, key=lambda r: r[0])
    want = Counter((r[0], *x) for r, x in zip(ordered, brute_repeats([(r[1] or "").encode() for r in ordered]), strict=True))
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in got) == want


def test_repeats_with_null_and_equal_ids(spark, odd, odd_rows, empty):
    """The order of equal ids is that of a hash of the text, as documented; null comes last."""
    hashes = {r["doc_id"]: r["h"] for r in spark.createDataFrame([(k, r[1] or "") for k, r in enumerate(odd_rows)], "doc_id int, t string").select("doc_id", F.xxhash64("t").alias("h")).collect()}
    order = sorted(range(len(odd_rows)), key=lambda k: (odd_rows[k][0] is None, odd_rows[k][0] or 0, hashes[k]))
    want = Counter((odd_rows[k][0], *x) for k, x in zip(order, brute_repeats([(odd_rows[k][1] or "").encode() for k in order]), strict=True))
    got = suffix_dedup.remove_repeats(odd).withColumn("sha", F.sha2("kept", 256)).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in got) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_as_text_keep_whole_characters(odd, odd_rows, empty):
    got = suffix_dedup.remove_repeats(odd, as_text=True)
    assert got.count() == odd.count() and set(odd.columns) <= set(got.columns)
    texts = {}
    for r in odd_rows:
        texts.setdefault(r[0], []).append(r[1] or "")
    for r in got.collect():
        assert "\ufffd" not in r["text"] and r["n_removed"] == r["n_bytes"] - len(r["text"].encode()) and r["n_bytes"] in {len(t.encode()) for t in texts[r["doc_id"]]}
    assert suffix_dedup.remove_repeats(empty, as_text=True).count() == 0


def test_repeats_with_ids_that_are_no_numbers(spark):
    passage = "".join(chr(97 + (k * k + k // 7) % 26) for k in range(150))
    docs = spark.createDataFrame([("x10", passage + " one"), ("x9", "two " + passage), (None, passage), ("a", "nothing like it")], "doc_id string, text string")
    assert {r["doc_id"]: r["n_removed"] for r in suffix_dedup.remove_repeats(docs).collect()} == {"x10": 0, "x9": 150, None: 150, "a": 0}


def test_multikey_quicksort_orders_by_bytes():
    rng = np.random.default_rng(4)
    rows = np.concatenate((rng.integers(0, 3, (900, 16)), np.zeros((300, 16), np.int64), rng.integers(0, 255, (500, 16)))).astype(np.uint8)
    order = suffix_dedup.multikey_quicksort(rows)
    assert [rows[i].tobytes() for i in order] == sorted(r.tobytes() for r in rows) and sorted(order.tolist()) == list(range(len(rows)))


def test_buckets_are_ranges_of_whole_rows():
    rng = np.random.default_rng(5)
    rows = rng.integers(0, 2, (400, 24)).astype(np.uint8)
    splitters = suffix_dedup.choose_splitters(np.unique(rows[:90], axis=0), 12)
    got, keys = suffix_dedup.bucket_of(rows, splitters), [s.tobytes() for s in splitters]
    assert got.tolist() == [sum(k <= r.tobytes() for k in keys) for r in rows]


def test_strings_of_a_run_and_its_place_survive_packing():
    rng = np.random.default_rng(7)
    data = np.concatenate((rng.integers(1, 255, 700).astype(np.uint8), np.zeros(100, np.uint8)))
    begin, more, off = np.array([3, 40, 597]), np.array([30, 0, 3]), np.array([40, 68, 5])
    ids, ties = np.array([-5, 2**62, 7]), np.array([-(2**63), 1, -1])
    rows = suffix_dedup._unpacked(suffix_dedup._packed(suffix_dedup.suffix_rows(data, begin, more, off, suffix_dedup._tails(ids, ties, begin))))
    strings = suffix_dedup.string_rows(rows)
    want = [(int(ids[i]), int(ties[i]), int(begin[i]) + k, data[begin[i] + k : begin[i] + k + 100].tobytes()) for i in range(3) for k in range(int(more[i]) + 1)]
    assert list(zip(*[x.tolist() for x in suffix_dedup._untailed(strings)], [s[:100].tobytes() for s in strings], strict=True)) == want


def test_equal_strings_have_equal_anchors():
    rng = np.random.default_rng(6)
    text = rng.integers(97, 110, 1000).astype(np.uint8)
    data = np.concatenate((rng.integers(97, 110, 333).astype(np.uint8), text, rng.integers(97, 110, 77).astype(np.uint8)))
    inner = suffix_dedup.anchor_runs(text, np.array([0]), np.array([1000]))
    outer = suffix_dedup.anchor_runs(data, np.array([0]), np.array([len(data)]))
    assert set(inner[4].tolist()) <= set(outer[4].tolist())
    assert int((inner[2] + 1).sum()) == 901


# ---- 8 SimHash


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for k in range(64):
            counts[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * counts[k] > len(shingles))


def brute_classes(prints):
    """(id, fingerprint) rows to the smallest id reachable."""
    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(a)] = root(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return Counter((i, f, least.get(root(f))) for i, f in prints)


def test_simhash_classes(odd, odd_rows, empty):
    prints = [(i, brute_fingerprint(t)) for i, t in ids_and_texts(odd_rows)]
    got = Counter((r["doc_id"], r["fp"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.classes(odd).collect())
    assert got == brute_classes(prints)
    kept = simhash_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    classes = {c for _, _, c in brute_classes(prints)}
    # One more than there are ids: two texts share an id, and each is the first of a class.
    assert kept.count() == len(classes) + 1 and {r["doc_id"] for r in kept.collect()} == classes
    assert simhash_dedup.classes(empty).count() == 0 and simhash_dedup.keep_one(empty).count() == 0


@pytest.mark.parametrize("limit", [1000, 3, 1])
def test_links_at_several_shard_sizes(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash_dedup, "SHARD_LIMIT", limit)
    rng = np.random.default_rng(8)
    prints = []
    for base in rng.integers(0, 2**63, 12).tolist():
        x = base
        for _ in range(20):
            prints.append(x)
            for bit in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                x ^= 1 << bit
    signed = [x - 2**64 if x >= 2**63 else x for x in prints]
    found = simhash_dedup.links(spark.createDataFrame([(x,) for x in set(signed)], "fp long"))
    for r in found.collect():
        assert (r["a"] & (2**64 - 1) ^ r["b"] & (2**64 - 1)).bit_count() <= 2
    labels = {r["node"]: r["label"] for r in simhash_dedup.connected(found).collect()}
    groups = Counter()
    for x in set(signed):
        groups[labels.get(x, x)] += 1
    want = defaultdict(set)
    for i, f, c in brute_classes([(k, x) for k, x in enumerate(prints)]):
        want[c].add(f)
    assert sorted(groups.values()) == sorted(map(len, want.values()))


# ---- 9 SentencePiece


def test_encoding_equals_the_library(odd, odd_rows, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sentence_pieces.MODEL))
    got = sentence_pieces.decode(sentence_pieces.encode(odd)).collect()
    want = Counter((i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in ids_and_texts(odd_rows))
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded_text"]) for r in got) == want
    both = odd.select("doc_id", sentence_pieces.round_trip(odd).alias("t")).select("doc_id", "t.*").collect()
    assert Counter((r["doc_id"], tuple(r["token_ids"]), r["decoded_text"]) for r in both) == want
    assert sentence_pieces.encode(empty).count() == 0


@pytest.mark.parametrize("table, lot", [(40, 3), (0, 1)])
def test_rare_chunks_are_encoded_by_the_tasks(spark, odd, odd_rows, monkeypatch, table, lot):
    import sentencepiece

    monkeypatch.setattr(sentence_pieces, "TABLE_CHUNKS", table)
    monkeypatch.setattr(sentence_pieces, "COUNTED_CHUNKS", 100)
    found = sentence_pieces.frequent_chunks(odd)
    assert len(found) <= table and (table == 0 or found)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sentence_pieces.MODEL))
    want = Counter((i, tuple(sp.encode(t or ""))) for i, t in ids_and_texts(odd_rows))
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in sentence_pieces.encode(odd).collect()) == want
    counts = Counter(c for _, t in ids_and_texts(odd_rows) for c in sentence_pieces.chunks_of(t))
    assert {r["chunk"]: r["n"] for r in sentence_pieces.count_chunks(odd).collect()} == counts


def test_any_text_encodes_as_the_library_does(monkeypatch):
    import sentencepiece
    from hypothesis import given, settings
    from hypothesis import strategies as st

    monkeypatch.setattr(sentence_pieces, "TASK_CHUNKS", 20)
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(sentence_pieces.MODEL))
    known = ["▁a", "▁", "b", "▁▁"]
    encoder = sentence_pieces.Encoder(dict(zip(known, sentence_pieces.segmented(known), strict=True)))

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tabe<0x>"), st.characters(blacklist_categories=("Cs",))), max_size=40), max_size=4))
    def holds(texts):
        assert [np.frombuffer(x, np.int32).tolist() for x in encoder.encode(texts)] == [sp.encode(t) for t in texts]

    holds()


def test_lots_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(sentence_pieces, "LOT_DOCS", 3)
    monkeypatch.setattr(sentence_pieces, "LOT_CHARS", 10)
    texts = ["a" * n if n is not None else None for n in (4, 4, 4, 20, None, 1, 1, 1, 1, 9)]
    cut = [x.to_pylist() for x in sentence_pieces.lots(iter([pa.array(texts), pa.array([], pa.string())]))]
    assert sum(cut, []) == texts and all(len(x) <= 3 and (len(x) == 1 or sum(map(len, filter(None, x))) <= 10) for x in cut)


# ---- 10 toxicity


def test_toxicity_is_learnt(spark, odd, empty):
    import random

    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for k in range(600):
        text = [rng.choice(words) for _ in range(60)]
        bad = k % 5 == 1
        if bad:
            text.insert(rng.randrange(60), rng.choice(["zzvile", "zzvilest"]))
        rows.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    rows += [(1000, None), (1001, ""), (None, "zzvile " * 3), (0, rows[0][1])]
    labels += [(5000, 1), (None, 1), (3, 1), (3, 0), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.rate(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 5 == 1) for r in held) / len(held) > 0.97
    nobody = toxicity.rate(odd, marks.limit(0)).collect()
    assert len(nobody) == odd.count() and all(r["score"] == pytest.approx(0.5) for r in nobody)
    assert toxicity.rate(empty, marks).count() == 0
