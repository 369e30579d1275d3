import hashlib

import corpus_pipeline
from tokenizers import Tokenizer

from gridweave.llm import bpe, bytecnn, exact, mixing, simhash

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_code(spark):
    """Each stage's decisions, recomputed from the scores or from brute force, take effect on the next."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in bytecnn.quality_scores(docs, labels).collect() if r.score >= 0.5}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in good}
    last = {}
    for i in sorted(texts):
        last["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in texts[i])] = i
    left = sorted(last.values())
    prints = {i: simhash.simhash(texts[i]) for i in left}
    part = {i: i for i in left}
    for _ in range(5):
        for a in left:
            for b in left:
                if (prints[a] ^ prints[b]).bit_count() <= 4:
                    part[a] = part[b] = min(part[a], part[b])
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    want = set()
    for i in set(part.values()):
        ids = t.encode(texts[i], add_special_tokens=False).ids
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, SF).collect()
    assert {tuple(r)[:3] for r in got} == want and len(got) == len(want)
    # the mixing stage puts rows in the order of its schedule, and the last keeps it
    sources = {r.doc_id: r.source for r in docs.collect()}
    assert [r.doc_id for r in got] == scheduled([(i, sources[i]) for i in set(part.values())])


def scheduled(rows):
    """Ids in the order of the schedule, slot by slot, with the production weights."""
    weights, queues = mixing.WEIGHTS, {}
    for i, source in sorted(rows, key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()):
        queues.setdefault(source if source in weights and source != mixing.OTHER else mixing.OTHER, []).append(i)
    blocks = {q: [ids[a : a + mixing.BLOCK] for a in range(0, len(ids), mixing.BLOCK)] for q, ids in sorted(queues.items())}
    out = []
    while any(blocks.values()):
        live = [q for q, b in blocks.items() if b]
        total, done = sum(weights[q] for q in live), dict.fromkeys(live, 0)
        for t in range(total):
            q = min((-(-(done[q] + 1) * total // weights[q]), n, q) for n, q in enumerate(live) if done[q] < weights[q] and done[q] * total // weights[q] <= t)[2]
            done[q] += 1
            if blocks[q]:
                out += blocks[q].pop(0)
    return out


def test_the_order_outlives_the_table_between_stages(spark, tmp_path):
    """Stage four's output, written and read again, is still in the schedule's order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    corpus_pipeline.mixed_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    got = [r.doc_id for f in sorted((tmp_path / "mixed").glob("part-*")) for r in spark.read.parquet(str(f)).select("doc_id").collect()]
    assert got == scheduled([(r.doc_id, r.source) for r in docs.collect()]) and got != sorted(got)


def test_stage_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_null_and_repeated_ids(spark):
    """A text is dropped for its quality or its copies, never for its id."""
    said = ["the cat sat on the mat", "green hills lie beyond the old river town", "she counted seven boats in the harbour", "snow fell all night upon the silent road"]
    rows = [(None, said[0]), (None, said[0].upper()), (None, said[1]), (7, said[2]), (7, said[3]), (8, said[3]), (9, said[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert sorted(map(str, bytecnn.keep_good(df, labels).collect())) == sorted(map(str, df.collect()))  # all score one half
    kept = [(r.doc_id, (r.text or "").lower()) for r in exact.drop_exact_copies(df).collect()]
    assert sorted(kept, key=str) == sorted([(None, said[0]), (None, said[1]), (7, said[2]), (9, said[3])], key=str)
    kept = [(r.doc_id, r.text.lower()) for r in simhash.drop_near_copies(df.where("text <> upper(text)")).collect()]
    assert sorted(kept, key=str) == sorted([(None, said[0]), (None, said[1]), (7, said[2]), (7, said[3])], key=str)
    twice = spark.createDataFrame([(5, said[0]), (5, said[1])], "doc_id long, text string")
    assert exact.drop_exact_copies(twice).count() == 2
