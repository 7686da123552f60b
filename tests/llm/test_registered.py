"""The registered queries on a folder of odd rows: whole results against brute force, columns and digests included."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from ledgerlens.llm import language_id, queries, toxicity
from ledgerlens.llm.shared import tokenizer_path
from tests.llm.test_documents_ops import brute_classes, brute_fingerprint, brute_measures, brute_repeats, brute_targets, ids_and_texts

LABELS = [(k, int(k % 3 == 0)) for k in range(100, 130)] + [(1, 0), (2, 1), (2, 0), (7, None), (None, 1)]


@pytest.fixture(scope="module")
def folder(spark, odd, odd_rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    odd.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(LABELS, "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(k, r[1] and r[1][:300], "x") for k, r in enumerate(odd_rows[:9])], "item_id long, text string, weight string").write.parquet(f"{path}/benchmark.parquet")
    return path


@pytest.fixture(scope="module")
def bare(spark, empty, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("bare"))
    empty.coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def held(i, folds, which):
    return i is not None and zlib.crc32(str(i).encode()) % folds == which


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n != "op3_ann"])
def test_empty_tables(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == 0


def test_op2(spark, folder, odd_rows):
    got = queries.op2_quality_rules(spark, folder).collect()
    assert got[0].__fields__[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = [(r[0], *m, m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in odd_rows for m in [brute_measures(r[1])]]
    assert Counter(tuple(r)[:7] for r in got) == Counter(want) and not any(r["kept"] and r["base_failed"] for r in got)


def test_op4(spark, folder, odd_rows):
    got = queries.op4_sharding(spark, folder).collect()
    assert got[0].__fields__[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in ids_and_texts(odd_rows))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots[s]) for s in range(40)]
    assert set(slots) <= set(range(40)) and max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}


def brute_language(rows):
    """(doc_id, prediction, score) by the documented rules, without any limit that these few rows would reach."""
    letters_of = lambda t: [w for run in re.findall(r"[^\W\d_]+", (t or "").lower()) if (w := "".join(filter(str.isalpha, run)))]
    grams_of = lambda w, n: [f"\x02{w}\x03"[i : i + n] for i in range(len(w) + 3 - n)]
    train = [(r[1], r[2]) for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and not held(r[0], 4, 2)]
    langs = sorted({lang for _, lang in train})
    seen, grams = {x: Counter() for x in langs}, {x: Counter() for x in langs}
    for text, lang in train:
        seen[lang].update(letters_of(text))
    for x in langs:
        for w, n in seen[x].items():
            for size in range(1, 6):
                for g in grams_of(w, size):
                    grams[x][g] += n
    known = {x: {w: n for w, n in seen[x].items() if n > 1} for x in langs}

    def logs(counts):
        names, totals = set().union(*counts.values()), {x: sum(c.values()) for x, c in counts.items()}
        return {g: [math.log(counts[x].get(g, 0) + 0.5) - math.log(totals[x] + 0.5 * max(1, len(names))) for x in langs] for g in names}

    by_word, by_gram, out = logs(known), logs(grams), []
    for r in rows:
        sums = [0.0] * len(langs)
        found = letters_of(r[1])
        for w in found:
            rows_ = [by_word[w]] if w in by_word else next((x for n in range(5, 0, -1) if (x := [by_gram[g] for g in grams_of(w, n) if g in by_gram])), [[0.0] * len(langs)])
            sums = [s + sum(x[k] for x in rows_) / len(rows_) for k, s in enumerate(sums)]
        if not found:
            out.append((r[0], "und", 0.0))
            continue
        best = max(range(len(langs)), key=lambda k: (sums[k], -k))
        out.append((r[0], langs[best], 1 / sum(math.exp(max(-700, s - sums[best])) for s in sums)))
    return out


def test_op5(spark, folder, odd_rows):
    got = queries.op5_language_id(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[2])
    for a, b in zip(sorted(((r["doc_id"], r["lang_pred"], r["score"]) for r in rows), key=key), sorted(brute_language(odd_rows), key=key), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)
    assert all(r["held_out"] == held(r["doc_id"], 4, 2) for r in rows)


def test_op5_without_limits(spark, odd):
    """The limits of the model are parameters: with none, and with a narrow one, the languages are still told apart."""
    training = odd.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    free = language_id.fit(training, max_words=None, max_grams=None, least_seen=1)
    narrow = language_id.fit(training, max_words=5, max_grams=5)
    assert len(free.words) > len(language_id.fit(training).words) >= len(narrow.words) and len(narrow.grams) <= 5 * 5 * 3
    assert {r["lang_pred"] for r in language_id.predict(odd, narrow).collect()} <= {"de", "en", "fr", "und"}


def test_op6(spark, folder, odd_rows):
    got = queries.op6_mixing(spark, folder).collect()
    assert got[0].__fields__[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    sizes = Counter()
    for r in odd_rows:
        sizes[r[3]] += len(words(r[1]))
    targets, taken, largest = brute_targets(sizes), Counter(), Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len(words(r[1]))) for r in odd_rows)
    assert all(abs(taken[s] - targets[s]) <= largest[s] / 2 + 1 for s in sizes)


@pytest.mark.parametrize("rows", [4, 50_000])
def test_mixing_does_not_depend_on_partitions(odd, monkeypatch, rows):
    from ledgerlens.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK_ROWS", rows)
    results = [Counter(tuple(map(str, r)) for r in mixing.rounded(odd.repartition(n, "n_chars")).collect()) for n in (1, 5)]
    assert results[0] == results[1]


def test_op7(spark, folder, odd_rows):
    from pyspark.sql import functions as F

    got = queries.op7_suffix_dedup(spark, folder)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    hashes = {r["k"]: r["h"] for r in spark.createDataFrame([(k, r[1] or "") for k, r in enumerate(odd_rows)], "k int, t string").select("k", F.xxhash64("t").alias("h")).collect()}
    order = sorted(range(len(odd_rows)), key=lambda k: (odd_rows[k][0] is None, odd_rows[k][0] or 0, hashes[k]))
    want = Counter((odd_rows[k][0], *x) for k, x in zip(order, brute_repeats([(odd_rows[k][1] or "").encode() for k in order]), strict=True))
    assert Counter(tuple(r)[:5] for r in got.collect()) == want


def test_op8(spark, folder, odd_rows):
    got = queries.op8_simhash_dedup(spark, folder)
    assert got.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    want = brute_classes([(i, brute_fingerprint(t)) for i, t in ids_and_texts(odd_rows)])
    assert Counter(tuple(r)[:3] for r in got.collect()) == Counter({(i, f"{f:016x}", c): n for (i, f, c), n in want.items()})


def test_op9(spark, folder, odd_rows):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    got = queries.op9_sentence_pieces(spark, folder)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter((i, len(x), sha(",".join(map(str, x))), sha(sp.decode(x))) for i, t in ids_and_texts(odd_rows) for x in [sp.encode(t or "")])
    assert Counter(tuple(r)[:4] for r in got.collect()) == want


def brute_buckets(text):
    """Hash buckets of the n-grams of 3 to 6 bytes, one by one."""
    data, top, out = f" {(text or '').lower()} ".encode(), (1 << 64) - 1, set()
    for n in (3, 4, 5, 6):
        for i in range(len(data) - n + 1):
            code = int.from_bytes(data[i : i + n], "big")
            h = (code * 0x9E3779B97F4A7C15 + n * 0xD1B54A32D192ED03) & top
            out.add(((h * 0xBF58476D1CE4E5B9) & top) >> 44)
    return out


def test_op10(spark, folder, odd, odd_rows):
    """Scores are those of the fitted weights summed one by one; features have the strongest ratios counted one by one."""
    got = queries.op10_toxicity(spark, folder)
    assert got.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert all(r["held_out"] == held(r["doc_id"], 5, 0) and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    learnt = [(i, t) for i, t in LABELS if i is not None and t is not None and i != 2 and not held(i, 5, 0)]
    labels = spark.createDataFrame([(i, t) for i, t in LABELS if i is None or not held(i, 5, 0)], "doc_id long, toxic int")
    model = toxicity.fit(odd.select("doc_id", "text"), labels)
    weights = {k: float(w) for k, w in enumerate(model.weights.tolist()) if w}
    want = sorted(1 / (1 + math.exp(-max(-60, min(60, model.bias + sum(weights.get(b, 0.0) for b in (brute_buckets(t) if t else ())))))) for _, t in ids_and_texts(odd_rows))
    assert sorted(r["score"] for r in rows) == pytest.approx(want, abs=1e-9)
    texts, counts, sizes = dict(ids_and_texts(odd_rows)), {0: Counter(), 1: Counter()}, Counter()
    for i, toxic in learnt:
        if i in texts:
            counts[toxic].update(brute_buckets(texts[i]))
            sizes[toxic] += 1
    both = counts[0] + counts[1]
    strength = {b: abs(math.log((counts[1][b] + 1) / (sizes[1] + 2)) - math.log((counts[0][b] + 1) / (sizes[0] + 2))) * math.sqrt(n) for b, n in both.items() if n >= toxicity.MIN_DOCS}
    cut = sorted(strength.values(), reverse=True)[: toxicity.FEATURES][-1]
    assert weights and all(strength[b] >= cut - 1e-9 for b in weights)


def test_op11(spark, folder, odd_rows):
    got = queries.op11_importance(spark, folder)
    assert got.columns[:5] == ["doc_id", "n_features", "weight", "score", "rank"]
    found = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    codes = lambda w: [zlib.crc32(x) % 10_000 for x in [*w, *(a + b" " + b for a, b in zip(w, w[1:]))]]
    s, t = Counter(), Counter()
    for r in odd_rows:
        s.update(codes(found(r[1])))
    for r in odd_rows[:9]:
        t.update(codes(found(r[1] and r[1][:300])))
    s_all, t_all, scored = sum(s.values()), sum(t.values()), []
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + 10_000) / ((s[b] + 1) * (t_all + 10_000))))
    for r in odd_rows:
        words_, doc = found(r[1]), "" if r[0] is None else str(r[0])
        own = codes(words_)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{doc}".encode()).hexdigest()[:8], 16)
        scored.append((r[0], len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words_)))
    able = sorted((x for x in scored if x[4] >= 20), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    drawn = Counter((*x[:4], k + 1) for k, x in enumerate(able[: 25 * len(able) // 100]))
    rows = got.collect()
    assert Counter(tuple(r)[:4] for r in rows) == Counter(x[:4] for x in scored)
    assert Counter(tuple(r)[:5] for r in rows if r["rank"] is not None) == drawn and drawn


def test_op13(spark, folder, odd_rows):
    from tests.llm.test_new_operators import brute_digest

    got = queries.op13_periodic_runs(spark, folder)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    few = [r for r in odd_rows if len(r[1] or "") < 20_000]  # the two longest have no run by construction; tested apart
    rows = [tuple(r)[:8] for r in got.collect()]
    want = Counter(brute_digest(r[0], r[1]) for r in few)
    assert len(rows) == len(odd_rows) and not want - Counter(rows)
