"""Chats as a table (conv_id, turn, role, text): new chats, messages, titles, deletion. Each is a new DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

COLUMNS = ("conv_id", "turn", "role", "text")


def titles(chats: DataFrame, length: int = 40) -> DataFrame:
    """(conv_id, title, n_turns): the start of a chat's first message."""
    return chats.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, length).alias("title"), F.count("*").alias("n_turns"))


def start(chats: DataFrame, greetings: DataFrame) -> DataFrame:
    """chats and new ones: greetings (role, text) each open a chat, numbered on from the last."""
    last = chats.agg(F.coalesce(F.max("conv_id"), F.lit(-1))).first()[0]
    own = greetings.withColumn("n", F.row_number().over(Window.orderBy("role", "text")))
    return chats.select(*COLUMNS).unionByName(own.select((F.lit(last) + F.col("n")).alias("conv_id"), F.lit(0).cast("long").alias("turn"), "role", "text"))


def send(chats: DataFrame, messages: DataFrame) -> DataFrame:
    """chats and messages (conv_id, seq, role, text), each after its chat's last turn in the order of seq; messages to no chat are left out."""
    last = chats.groupBy("conv_id").agg(F.max("turn").alias("last"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("seq"))
    added = messages.withColumn("n", place).join(last, "conv_id").select("conv_id", (F.col("last") + F.col("n")).alias("turn"), "role", "text")
    return chats.select(*COLUMNS).unionByName(added)


def rename(named: DataFrame, new: DataFrame) -> DataFrame:
    """named (conv_id, title, ...) with the titles of new (conv_id, title) in place of its own."""
    own = named.join(new.select("conv_id", F.col("title").alias("_new")), "conv_id", "left")
    return own.withColumn("title", F.coalesce("_new", "title")).drop("_new")


def delete(chats: DataFrame, gone: DataFrame) -> DataFrame:
    return chats.join(gone.select("conv_id"), "conv_id", "left_anti")
