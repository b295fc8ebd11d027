"""Token id arrays: clip, pad and truncate, masks and labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PAD, UNKNOWN, IGNORED = 0, 1, -100


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip_ids(ids: Column | str, vocab_size: Column | int) -> Column:
    """Ids outside the vocabulary become the unknown id."""
    return F.transform(_col(ids), lambda x: F.when(x < vocab_size, x).otherwise(UNKNOWN))


def pad_truncate(ids: Column | str, maxlen: int) -> Column:
    """Exactly ``maxlen`` ids: cut at the end or filled with 0 at the end."""
    kept = F.slice(_col(ids), 1, maxlen)
    return F.concat(kept, F.array_repeat(F.lit(PAD), F.greatest(F.lit(maxlen) - F.size(kept), F.lit(0))))


def attention_mask(ids: Column | str) -> Column:
    return F.transform(_col(ids), lambda x: (x != PAD).cast("int"))


def label_ids(ids: Column | str) -> Column:
    return F.transform(_col(ids), lambda x: F.when(x == PAD, IGNORED).otherwise(x))
