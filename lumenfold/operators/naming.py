"""Target names: numbers in a day's sequence, and suffixes against collisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import base_name, dir_name, raw_extension
from .ranking import position
from .store import stored


def split_names(paths: DataFrame, column: str = "path") -> DataFrame:
    """target_dir, name, base, raw_ext of paths."""
    out = paths.select(dir_name(F.col(column)).alias("target_dir"), base_name(F.col(column)).alias("name"))
    out = out.withColumn("raw_ext", raw_extension(F.col("name")))
    return out.withColumn("base", F.substring("name", F.lit(1), F.char_length("name") - F.char_length("raw_ext")))


def max_sequence(existing: DataFrame) -> DataFrame:
    """target_dir, prefix, max_seq: the largest number of names `prefix_number` with any extension. existing: path."""
    found = split_names(existing).withColumn("prefix", F.regexp_extract("base", r"^(\d{4}_\d{2}_\d{2})_\d+$", 1)).withColumn("seq", F.regexp_extract("base", r"^\d{4}_\d{2}_\d{2}_(\d+)$", 1).try_cast("bigint"))
    return found.where(F.col("prefix") != "").groupBy("target_dir", "prefix").agg(F.max("seq").alias("max_seq"))


def sequence_names(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rows (path, target_dir, prefix, ext) with seq and target_name: numbers go on from the largest there is, by path."""
    own = rows.withColumn("__dir", dir_name(F.col("path")))
    own = position(own, ["target_dir", "prefix"], "__dir", ["path"], "__rank").drop("__dir")
    if existing is None:
        own = own.withColumn("__max", F.lit(0).cast("bigint"))
    else:
        top = max_sequence(existing).withColumnsRenamed({"target_dir": "__target", "prefix": "__prefix", "max_seq": "__max"})
        own = own.join(top, (F.col("target_dir") == F.col("__target")) & (F.col("prefix") == F.col("__prefix")), "left").drop("__target", "__prefix")
    own = own.withColumn("seq", F.coalesce("__max", F.lit(0)) + F.col("__rank")).drop("__rank", "__max")
    return own.withColumn("target_name", F.concat("prefix", F.lit("_"), F.when(F.col("seq") < 1000, F.lpad(F.col("seq").cast("string"), 3, "0")).otherwise(F.col("seq").cast("string")), "ext"))


def assign(names: list[str], bases: list[str], exts: list[str], taken: set[str]) -> list[str]:
    """Each name if it is free, else its base with _1, _2, ...; in the order given."""
    next_of: dict[tuple[str, str], int] = {}
    out = []
    for name, base, ext in zip(names, bases, exts, strict=True):
        if name in taken:
            k = next_of.get((base, ext), 1)
            while (name := f"{base}_{k}{ext}") in taken:
                k += 1
            next_of[base, ext] = k + 1
        taken.add(name)
        out.append(name)
    return out


def free_numbers(rows: DataFrame, head: list[str], block: int = 1024) -> DataFrame:
    """head, __k, __number: the k-th number, for each new row of a group, that no existing name has; 0 stands for the name itself.

    rows: head columns, base, is_old. Numbers are counted by blocks: what exists in a block, then what blocks before it leave free. A
    group makes as many numbers as it has rows, in any task, and only one row for a block of them meets the other blocks.
    """
    tail = F.substring("base", F.char_length("head") + 2, F.char_length("base"))
    number = F.when(F.col("base") == F.col("head"), F.lit(0)).when(tail.rlike(r"^[1-9]\d{0,17}$"), tail.try_cast("bigint"))
    sizes = rows.groupBy(*head).agg(F.count("*").alias("__n"), F.count_if(~F.col("is_old")).alias("__new"))
    held = rows.where("is_old").withColumn("__number", number).where(F.col("__number").isNotNull())
    held = held.groupBy(*head, F.expr(f"__number div {block}").alias("__block")).agg(F.collect_set((F.col("__number") % block).cast("int")).alias("__held"))  # block values at most
    blocks = sizes.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(__n - 1) div {block}"))))
    every = F.sequence(F.lit(0), F.least(F.lit(block - 1).cast("bigint"), F.col("__n") - 1 - F.col("__block") * block).cast("int"))
    left = blocks.join(held, [*head, "__block"], "left").withColumn("__free", F.array_except(every, F.coalesce("__held", F.array().cast("array<int>"))))
    before = F.coalesce(F.sum(F.size("__free")).over(Window.partitionBy(*head).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = left.withColumn("__before", before).select(*head, "__new", "__block", "__before", F.posexplode("__free").alias("__pos", "__of"))
    return out.select(*head, (F.col("__before") + F.col("__pos") + 1).alias("__k"), (F.col("__block") * block + F.col("__of")).alias("__number"), "__new").where("__k <= __new").drop("__new")


def unique_names(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """rows (path, target_dir, name) with target_name, free in the directory and different for all rows.

    Names interact only with names that add _number to them. A name that occurs twice or exists heads a
    group with all names that add to it; the others stay. A group of one repeated name is numbered by its
    rows' positions, past the numbers that exist (`free_numbers`), over as many tasks as it needs; groups in
    which new names could meet each other's numbers run the exact loop, in path order.
    """
    key = ["target_dir", "base", "raw_ext"]
    own = rows.withColumn("raw_ext", raw_extension(F.col("name")))
    own = own.withColumn("base", F.substring("name", F.lit(1), F.char_length("name") - F.char_length("raw_ext"))).withColumn("is_old", F.lit(False))
    slim = own.select("path", "name", *key, "is_old")
    if existing is not None:
        old = split_names(existing).select(F.lit(None).cast("string").alias("path"), "name", *key, F.lit(True).alias("is_old"))
        old = old.join(rows.select("target_dir").distinct(), "target_dir", "left_semi").select(*slim.columns)
        slim = slim.unionByName(old)
    heads = slim.groupBy(*key).agg(F.count("*").alias("n"), F.count_if(~F.col("is_old")).alias("new")).where("n > 1 AND new > 0").select(F.col("target_dir").alias("__dir"), F.col("base").alias("__base"), F.col("raw_ext").alias("__ext"))
    # a name and what is left when endings _number are taken off, one by one
    tails = F.split(F.regexp_extract("base", r"((?:_\d+)*)$", 1), "_")
    ending = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.aggregate(F.slice(F.reverse(tails), F.lit(1), i), F.lit(0), lambda acc, x: acc + F.char_length(x) + 1))
    ways = F.filter(F.transform(F.sequence(F.lit(0), F.size(tails) - 1), lambda i: F.substring("base", F.lit(1), F.char_length("base") - ending(i))), lambda x: x != "")
    exploded = slim.withColumn("__way", F.explode(ways))
    met = exploded.join(heads, (F.col("target_dir") == F.col("__dir")) & (F.col("raw_ext") == F.col("__ext")) & (F.col("__way") == F.col("__base")))
    grouped = stored(met.groupBy("path", "name", *key, "is_old").agg(F.min_by("__way", F.char_length("__way")).alias("head")))
    head = ["target_dir", "head", "raw_ext"]
    kinds = grouped.groupBy(*head).agg(F.bool_or(~F.col("is_old") & (F.col("base") != F.col("head"))).alias("mixed"), F.bool_or("is_old").alias("old"))
    marked = grouped.join(kinds, head)
    one = position(marked.where(~F.col("is_old") & ~F.col("mixed")).withColumn("__from", dir_name(F.col("path"))), head, "__from", ["path"], "__k")
    free = free_numbers(marked.where(~F.col("mixed") & F.col("old")), head)
    numbered = one.where(~F.col("old")).select("path", "name", "base", "raw_ext", (F.col("__k") - 1).alias("__number"))
    numbered = numbered.unionByName(one.where("old").join(free, [*head, "__k"]).select("path", "name", "base", "raw_ext", "__number"))
    plain = numbered.select("path", F.when(F.col("__number") == 0, F.col("name")).otherwise(F.concat("base", F.lit("_"), F.col("__number").cast("string"), "raw_ext")).alias("target_name"))

    def loop(pdf: pd.DataFrame) -> pd.DataFrame:
        new = pdf[~pdf["is_old"]].sort_values("path")
        return pd.DataFrame({"path": new["path"], "target_name": assign(list(new["name"]), list(new["base"]), list(new["raw_ext"]), set(pdf[pdf["is_old"]]["name"]))})

    exact = marked.where("mixed").groupBy(*head).applyInPandas(loop, "path string, target_name string")
    changed = plain.unionByName(exact).withColumnsRenamed({"path": "__path", "target_name": "__name"})
    return rows.join(changed, F.col("path") == F.col("__path"), "left").withColumn("target_name", F.coalesce("__name", "name")).drop("__path", "__name")
