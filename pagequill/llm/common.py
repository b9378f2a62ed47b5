"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequill.functions.shared import MARK_WORDS, discard, join_by_group, mark_possible, materialize, new_path, shared_dir  # noqa: F401  what the operators share

def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def crc_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % n


def split_members(rows: DataFrame, key: str, members: DataFrame, member: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is in members.<member>, all others but those of a null key).

    Rows that the mark table leaves out are no members. Of the others only the
    keys are shuffled, to find the few that are marked by chance; theirs, and
    those that these few mark by chance, are all the whole rows that a join moves.
    """
    marked = mark_possible(rows.where(F.col(key).isNotNull()), F.col(key), members, member, "__possible")
    chance = materialize(marked.where("__possible").select(F.col(key).alias("__chance")).join(members, F.col("__chance") == F.col(member), "left_anti").distinct(), "chance-marks")
    if chance.isEmpty():  # as nearly always: no further look at the rows is due
        return marked.where("__possible").select(*rows.columns), marked.where(~F.col("__possible")).select(*rows.columns)
    again = mark_possible(marked.where("__possible"), F.col(key), chance, "__chance", "__again")
    unclear, same = again.where("__again"), F.col(key) == F.col("__chance")
    pick = lambda *parts: parts[0].select(*rows.columns).unionByName(parts[1].select(*rows.columns))
    return pick(again.where(~F.col("__again")), unclear.join(chance, same, "left_anti")), pick(marked.where(~F.col("__possible")), unclear.join(chance, same, "left_semi"))
