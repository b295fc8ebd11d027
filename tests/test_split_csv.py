"""Large CSV files with quoted line breaks: many parts give the rows that one reader gives."""

import csv
import random

import pytest

from corpusmill.sources import files
from corpusmill.sources.split_csv import ends_quoted, read_records

HEADER = ["question", "answer", "re\nmarks"]


def value(rng):
    return rng.choice(["", 'say "hi", ok', 'a\nb\n\n"c",\nd', "x,\n" * rng.randrange(60), 'q"' * rng.randrange(80), "naïve é", "w" * rng.randrange(30), "\n", '"', ","])


@pytest.fixture()
def part_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    spark.conf.set(keys[1], "0")
    yield lambda n: spark.conf.set(keys[0], str(n))
    for k, v in zip(keys, before):
        spark.conf.set(k, v)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_parts_give_the_same_rows(spark, tmp_path, part_size, end):
    rng = random.Random(len(end))
    want = []
    for name, coding, rows in (("a", "utf-8", 120), ("b", "utf-8-sig", 40), ("c", "utf-8", 1), ("d", "utf-8", 0)):
        some = [[f"{name}{i}", value(rng), value(rng)] for i in range(rows)]
        want += [tuple(x or None for x in r) for r in some]
        with open(tmp_path / f"{name}.csv", "w", newline="", encoding=coding) as f:
            csv.writer(f, lineterminator=end, quoting=csv.QUOTE_ALL if name == "b" else csv.QUOTE_MINIMAL).writerows([HEADER, *some])
    # An empty quoted value stays empty text, an empty plain one is null; both count as missing here.
    for size in (1 << 22, 350):
        part_size(size)
        got = files.read_text_csv(spark, str(tmp_path))
        assert got.columns == HEADER
        assert sorted((tuple(x or None for x in r) for r in got.collect()), key=repr) == sorted(want, key=repr)
    assert read_records(spark, str(tmp_path)).rdd.getNumPartitions() > 10


def test_stray_quotes_and_short_rows(spark, tmp_path, part_size):
    text = 'q,a\n5" pipe,open\n"it ""is""","a\n"" b"\nshort\n\n,\nlast,"unfinished\nvalue'
    (tmp_path / "x.csv").write_bytes(text.encode())
    part_size(9)
    got = sorted((tuple(r) for r in files.read_text_csv(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted([('5" pipe', "open"), ('it "is"', 'a\n" b'), ("short", None), (None, None), ("last", "unfinished\nvalue\n")], key=repr)


@pytest.mark.parametrize("line, outside, inside", [
    (b"a,b", False, True), (b'"a,b', True, False), (b'a","b', True, True), (b'"a""b"', False, False), (b'5" pipe', False, False), (b'""', False, True),
    (b'"",x', False, True), (b'"a"\r', False, False), (b'a,"', True, False), (b'x""y', False, True)])
def test_state_behind_a_line(line, outside, inside):
    assert (ends_quoted(line, False), ends_quoted(line, True)) == (outside, inside)
