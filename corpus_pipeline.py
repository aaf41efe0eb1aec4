"""From raw documents to packed training sequences, as stages that are written and read again.

1. language_id: documents that are null or have no letter are rejected; profiles are learned from the
   training fold of the same documents.
2. exact_dedup: of equal texts (A-Z lower-cased) the row with the largest id stays.
3. simhash_dedup: of each group of linked fingerprints the row with the smallest id stays.
4. decontaminate: documents into which a benchmark item leaks go.
5. best_fit_packing: what is left becomes pieces in sequences of at most 2048 tokens.

Defined cases are those of the operators: null texts end at the first stage; rows that repeat an id and
a text are one document from the second stage on; null ids are kept as they are; further columns pass
all stages but the last; an empty table, or an empty benchmark, goes through.
"""

from __future__ import annotations

from docket_spark.llm import decontaminate, exact_dedup, language, packing, simhash
from docket_spark.llm.columns import fold_of
from docket_spark.llm.queries import BYTE_BPE, table
from docket_spark.session import cut_lineage


def language_id(spark, docs, sf_dir):
    profiles = language.learn_profiles(docs, learn_from=fold_of("doc_id", 4) != 2)
    return language.keep_known(docs, profiles)


def exact(spark, docs, sf_dir):
    return exact_dedup.deduplicate(docs)


def near(spark, docs, sf_dir):
    return simhash.keep_one(docs)


def clean(spark, docs, sf_dir):
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark, docs, sf_dir):
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontaminate", clean),
    ("best_fit_packing", packed),
]
# The trained profiles, the fingerprints and the edit distances are beyond SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages on ``documents``; each result is written to the checkpoint folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
