"""A corpus pipeline from the operators of quire.llm.

Each stage works on all that its predecessor kept, which is written as Parquet to the shared folder
and read again. All but the last return the columns of documents; n_chars follows the text.

1. language: documents in which no language is told (no letter, or a text that isn't short has a score under LEAST_SCORE) go.
2. near_duplicates: of each group of near copies the document of the least id stays.
3. personal_data: entities are replaced by their kind, terms that disclose them generalised or removed.
4. mixing: poor and toxic documents are thinned out to the token shares of TARGETS beside the good ones, which all stay.
   Where they are scarcer than that they stay as they are; nothing is repeated.
5. tokens: ids of every whole text with the byte span of each in it.

What a stage has written is removed once its successor has written its own.

Cases: null, empty and letterless texts have no language and go in the first stage; rows without an id stay up to the last, since
nothing tells copies of them apart; of rows that repeat an id and a text one stays; an empty table gives no rows; further columns,
whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import langid, mixing, pii, sentencepiece_codec, simhash
from quire.llm.common import shared_folder, table
from quire.llm.registry import PIECES, TARGETS, domains

#: Below it the network is torn between languages: even two that are equally likely score 0.5.
LEAST_SCORE = 0.4


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = langid.fit(docs, ~langid.held_out())
    return langid.kept(docs, net, LEAST_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = pii.sanitise(docs)
    return clean.withColumn("n_chars", F.length("text").cast(clean.schema["n_chars"].dataType))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.sampled(docs, domains(table(spark, sf_dir, "labels")), TARGETS, budget=0)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(docs, public_tokenizers.path(PIECES))


STAGES: list = [("language", language), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixed), ("tokens", tokens)]
#: Trained models and near copies are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}_{name}")
        docs = spark.read.parquet(path)
        if before:
            gone = spark._jvm.org.apache.hadoop.fs.Path(before)
            gone.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(gone, True)
        before = path
    return docs
