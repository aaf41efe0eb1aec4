"""The pipeline against its stages written out plainly, and the registered queries."""

import collections
import random

import corpus_pipeline
from docket_spark.llm import packing, queries
from docket_spark.llm.queries import BYTE_BPE
from tests.llm.tables import PROSE, documents, hard_rows
from tests.llm.test_near import all_pairs, plain_fingerprint
from tests.llm.test_texts import pieces


def corpus(draw):
    vocabulary = ["".join(draw.choices("abcdefghij", k=draw.randint(2, 9))) for _ in range(3000)]
    invent = lambda n: " ".join(draw.choices(vocabulary, k=n))
    items = [(k, invent(25)) for k in range(5)]
    rows, gone = [r for r in hard_rows() if r[0] is not None], {2, 3, 4, 8}
    for k in range(100, 160):
        rows.append((k, invent(300), "en"))
    for k in range(5):  # exact copies: the largest id stays
        rows.append((200 + k, rows[-1 - k][1].upper() if k == 0 else rows[-1 - 2 * k][1], "en"))
    copies = collections.defaultdict(list)
    for i, text, *_ in rows:
        copies[(text or "").lower()].append(i)
    for ids in copies.values():
        gone |= set(ids) - {max(ids)}
    for k in range(15):
        text = next(t for i, t, *_ in rows if i == 120 + k).split()
        text[50] = "changed"
        rows.append((300 + k, " ".join(text), "en"))
    for k, item in items:
        rows.append((400 + k, f"{invent(80)} {item.upper()} {invent(40)}", "en"))
    # near copies: the smallest id stays
    groups = all_pairs({i: plain_fingerprint(t) for i, t, *_ in rows if i not in gone}, 4)
    near = {i for i, least in groups.items() if i != least}
    assert near and near < {300 + k for k in range(15)}
    gone |= near | {400 + k for k, _ in items}  # and the leaks
    return rows, items, gone


def test_run_keeps_what_the_stages_keep(spark, tmp_path):
    rows, items, gone = corpus(random.Random(14))
    docs = documents(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = {i: t for i, t, *_ in rows if i not in gone}
    want = {(i, k) for i, t in texts.items() for k in range(len(pieces(t, 2048)[0]))}
    assert {(r.doc_id, r.piece) for r in found} == want and len(found) == len(want)
    filled = collections.Counter()
    for r in found:
        filled[r.sequence_id] += r.length
    assert max(filled.values()) <= 2048
    assert len(filled) == -(-sum(filled.values()) // 2048) or len(filled) < len(want)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    docs = documents(spark, [*hard_rows(), (9, PROSE + " " + PROSE, "de")])
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet"
    )
    for rows in (docs, docs.limit(0)):
        left = rows
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            left = stage(spark, left, str(tmp_path))
            folder = f"{tmp_path}/{rows is docs}-{name}"
            left.write.parquet(folder)
            left = spark.read.parquet(folder)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert left.columns == docs.columns
    assert left.columns == packing.pack(docs, BYTE_BPE).columns and left.count() == 0


def test_names_of_stages_and_queries():
    assert [n for n, _ in corpus_pipeline.STAGES][2] == "simhash_dedup"
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
