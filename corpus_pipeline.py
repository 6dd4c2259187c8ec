"""The corpus pipeline: five training-data operators, each on all that the one before it kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns the next
docs, which are written as Parquet and read again before the next stage. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from haulage.llm import ngram_join, quality_classifier, source_mix, suffix_decontamination, token_codes
from haulage.llm.common import cut, table


# the near-duplicate stage is operator 4's, with the values of its contract
SHINGLE_WORDS, SIMILAR_PERCENT = 4, 85


def quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality_classifier.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """One row of each group of linked rows stays, the one with the smallest id."""
    return ngram_join.keep_rows(docs, words=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def decontamination(spark, docs, sf_dir):
    """Rows that hold a window of a benchmark item go."""
    return suffix_decontamination.clean_rows(docs, table(spark, sf_dir, "benchmark"))


def mix(spark, docs, sf_dir):
    """Every document as often as the mix takes it: not at all, once, or repeated."""
    return source_mix.mixed(docs)


def token_ids(spark, docs, sf_dir):
    """Token ids of every document, written in directly addressable codes and read back."""
    return token_codes.read_codes(token_codes.write_codes(docs), with_ids=False).drop("ids")


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates),
          ("benchmark decontamination", decontamination), ("mixing sources to target weights", mix),
          ("token-ID / binary output", token_ids)]

# the classifier, the hash-drawn mix of what it keeps and the tokenizer are beyond SQL
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, "stage")
    return docs
