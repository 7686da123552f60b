"""The pipeline against its stages done by brute force."""

import re
from collections import Counter

import corpus_pipeline
from ledgerlens.llm import pipeline
from ledgerlens.llm.shared import staged, tokenizer_path
from tests.llm.test_documents_ops import brute_measures, brute_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _cut(rows):
    """Texts without the bytes that repeat, whole characters only."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        b = (r["text"] or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                covered[s : s + 100] = b"\x01" * 100
            seen.add(w)
        kept, at = [], 0
        for c in (r["text"] or ""):
            n = len(c.encode())
            if not all(covered[at : at + n]):
                kept.append(c)
            at += n
        if kept or not any(covered):
            out.append((r["doc_id"], "".join(kept)))
    return out


def brute_similar(rows, words=5):
    """The smallest id of each class of texts that pairs of a Jaccard similarity of 0.8 or more connect."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sorted(sets):
        for j in sorted(sets):
            if i < j and 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j])):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {root(i) for i in sets}


def test_pipeline_stage_by_stage(spark):
    import sentencepiece

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        docs = staged(stage(spark, docs, "/root/testdata/sf0.001"))
        after = docs.collect()
        if k < 4:
            assert docs.columns == COLUMNS, name
        if k == 0:
            good = {r["doc_id"] for r in before for m in [brute_measures(r["text"])] if m[0] >= 10 and 100 * m[4] <= 20 * m[0]}
            assert {r["doc_id"] for r in after} == good  # no host is bad as a whole here
        elif k == 1:
            assert {r["doc_id"] for r in after} == brute_similar([(r["doc_id"], r["text"]) for r in before])
        elif k == 2:
            assert Counter((r["doc_id"], r["text"]) for r in after) == Counter(_cut(before))
            assert all(r["n_chars"] == len(r["text"]) for r in after)
        elif k == 3:
            size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
            sizes = Counter()
            for r in before:
                sizes[r["source"]] += size(r["text"])
            target, copies = brute_targets(sizes), Counter(r["doc_id"] for r in after)
            taken, largest = Counter(), Counter()
            for r in before:
                taken[r["source"]] += copies[r["doc_id"]] * size(r["text"])
                largest[r["source"]] = max(largest[r["source"]], size(r["text"]))
            assert max(copies.values()) <= 3 and all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
        else:
            sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
            assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in after) == Counter((r["doc_id"], tuple(sp.encode(r["text"]))) for r in before)
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == len(after)


def test_stages_take_odd_rows(spark, odd, odd_rows, empty):
    """Nulls, empty and very long texts, ties, repeated rows and columns named as the operators' own."""
    for rows in (odd, empty):
        docs = rows
        for k, (name, stage) in enumerate(pipeline.STAGES):
            new = staged(stage(spark, docs, ""))
            assert k == 4 or new.columns == rows.columns, name
            assert rows is odd or new.count() == 0, name
            docs = new
    # Each stage on the odd rows themselves: what is null, empty or repeated meets the later stages too.
    for name, stage in pipeline.STAGES[1:]:
        got = stage(spark, odd, "").collect()
        assert {r["doc_id"] for r in got} <= {r[0] for r in odd_rows}, name
        if name.startswith("SentencePiece"):
            assert len(got) == len(odd_rows) and {r["n_tokens"] for r in got if r["doc_id"] in (5, 6)} == {0}
    kept = [(r["doc_id"], r["text"]) for r in pipeline.near_duplicates(spark, odd, "").collect()]
    assert len(kept) == len(set(kept)) and {i for i, _ in kept} & {1, 2} == {1}
    bad = {r[0] for r in odd_rows if brute_measures(r[1])[0] < 10}
    assert not bad - {None, 11} & {r["doc_id"] for r in pipeline.quality(spark, odd, "").collect()}
