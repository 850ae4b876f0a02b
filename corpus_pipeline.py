"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes the documents that its predecessor kept and returns documents, and the last
returns packed pieces:

1. ``toxicity``: documents that the random field scores 0.3 or more go.
2. ``lines``: lines found in five documents or more stay in one of them.
3. ``minhash``: one document of each class of near-duplicates stays, the one of least id;
   documents of null id all stay.
4. ``substrings``: passages of fifty words or more of an earlier document are cut out.
5. ``packing``: what is left is tokenised and packed into sequences of 1,024 tokens.

Documents that a stage does not touch keep their text byte for byte. ``n_chars`` follows the
text. A document that loses all its text stays as an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motefield.llm import lines, minhash, packing, substrings, toxicity
from motefield.llm.queries import table, tokenizer_path
from motefield.storage import materialize, temporary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # under names of their own, columns of the input clash with none of the operator's
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    others = tuple(own[c] for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    found = lines.dedup_lines(docs.toDF(*own.values()), key=own["doc_id"], text=own["text"], carry=others)
    changed = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return found.select(*[changed.get(c, F.col(name)).alias(c) for c, name in own.items()])


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = minhash.near_duplicate_classes(docs).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_documents(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("lines", drop_common_lines),
    ("minhash", keep_one_of_each_class),
    ("substrings", cut_repeated_passages),
    ("packing", pack),
]

#: The first stage is a trained model, which SQL cannot state.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents; what a stage keeps is written and read again, and
    then what it wrote on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark, keep=f"kept_{name}"):
            docs = materialize(stage(spark, docs, sf_dir), f"kept_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
