"""Raw lines against a character-by-character reader."""

import random

import pytest

from intervane.operators.rejects import parse_lines, split_lines

LINES = "line_id BIGINT, file_name STRING, line_no INT, line_text STRING, seqname STRING"
SIZES = {"chr1": 1000, 'chr"x': 500}


def brute(line, n_columns):
    """(reason, fields) of one line; None for a line that is no data line."""
    if line is None:
        return None
    line = line[:-1] if line.endswith("\r") else line
    bare = line.lstrip(" \t")
    if not bare or bare[0] == "#" or line.startswith(("track ", "browser ")):
        return None
    fields, i, bad = [], 0, False
    while True:
        if line[i : i + 1] == '"':
            value, i = "", i + 1
            while i < len(line):
                if line[i] != '"':
                    value, i = value + line[i], i + 1
                elif line[i : i + 2] == '""':
                    value, i = value + '"', i + 2
                else:
                    break
            i += 1
            bad |= i > len(line) or i < len(line) and line[i] != "\t"
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
        else:
            j = line.find("\t", i)
            j = len(line) if j < 0 else j
            value = line[i:j]
            bad |= '"' in value
        fields.append(value)
        i = j + 1
        if j >= len(line):
            break
    digits = lambda x: x != "" and set(x) <= set("0123456789")
    if bad:
        return "quoting", fields
    if len(fields) not in ((3, 4) if n_columns is None else (n_columns,)):
        return "column_count", fields
    if fields[0] not in SIZES:
        return "seqname", fields
    if not digits(fields[1]):
        return "start", fields
    if not digits(fields[2]):
        return "end", fields
    if int(fields[2]) <= int(fields[1]) or int(fields[2]) > SIZES[fields[0]]:
        return "bounds", fields
    return "", fields


def made_lines():
    rng = random.Random(7)
    bits = ['"', '""', "\t", "\t", "chr1", "10", "20", "007", "+5", "-5", " 9", "9 ", "1e2", "", "a", "#", "\r", "x", "9" * 25, "0" * 30 + "5", "\x01", "é", "\n", "٣", "1.0", "track ", ","]
    lines = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 9))) for _ in range(1500)]
    start = ["chr1", '"chr1"', 'chr1"', "chr2", " chr1", "", '"chr""x"', '"chr1']
    number = ["5", '"7"', "0012", "", "+3", "-1", "999", "1000", "1001", "3.0", " 4", "٣", "9" * 20, '"1', '1"', "0"]
    tail = ["", "\tname", '\t"a\tb"', '\t"q""q"', "\t", "\tn\tm", "\r", "\tname\r", "\t\r", '\t"open', '\tin"side', "\r\r"]
    lines += ["\t".join((rng.choice(start), rng.choice(number), rng.choice(number))) + rng.choice(tail) for _ in range(3000)]
    good = ["chr1\t1\t9", 'chr1\t"1"\t9\t"a"', "  # note", "\t \t", "track x", "browser y", "browserz\t1\t2", "trackx", "chr1\t1\t9\t" + "y" * 300_000, 'chr1\t1\t9\t"' + '""' * 100_000 + '"', "chr1\t5\t5", "chr1\t0\t1000"]
    return [None, *good, *lines]


def test_lines_agree_with_brute_force(spark):
    rows, want = [], {}
    for i, line in enumerate(made_lines()):
        for j, (file, n) in enumerate((("a", 3), ("b", 4), ("none", None), (None, None))):
            rows.append((i * 4 + j, file, i, line, "clash"))
            if (judged := brute(line, n)) is not None:
                want[i * 4 + j] = judged
    lines = spark.createDataFrame(rows, LINES)
    files = spark.createDataFrame([("a", "s", 3, 1), ("b", "s", 4, 1)], "file_name STRING, sample STRING, n_columns INT, reason INT")
    sizes = spark.createDataFrame([*SIZES.items(), (None, 5)], "seqname STRING, size_ BIGINT")
    got = {r["line_id"]: r for r in parse_lines(lines, files, sizes).collect()}
    assert got.keys() == want.keys()
    for i, (reason, fields) in want.items():
        assert (got[i]["reason"] or "") == reason, (got[i]["line_text"][:100], reason)
        if not reason:
            assert (got[i]["seqname"], got[i]["start_"], got[i]["end_"]) == (fields[0], int(fields[1]), int(fields[2]))
            assert got[i]["name"] == (fields[3] if len(fields) == 4 else f"read-{got[i]['line_no']}")


def test_deliveries_count_once_and_empty_tables(spark):
    files = spark.createDataFrame([("a", "s", 3)], "file_name STRING, sample STRING, n_columns INT")
    sizes = spark.createDataFrame([("chr1", 10)], "seqname STRING, size_ BIGINT")
    lines = spark.createDataFrame([(1, "a", 1, "chr1\t1\t2", ""), (1, "a", 1, "chr1\t1\t2", ""), (2, "a", 2, "chr1", ""), (2, "a", 2, "chr1", "x"), (None, "a", 3, "chr1", "")], LINES)
    fragments, rejects = split_lines(lines, files, sizes)
    assert [tuple(r) for r in fragments.collect()] == [(1, "s", "chr1", 1, 2, "read-1", 1)]
    assert sorted(((r["line_id"], r["reason"]) for r in rejects.collect()), key=str) == [(2, "column_count"), (None, "column_count")]
    for empty in split_lines(lines.limit(0), files.limit(0), sizes.limit(0)):
        assert empty.count() == 0
    assert {r["reason"] for r in split_lines(lines, files.limit(0), sizes.limit(0))[1].collect()} == {"seqname", "column_count"}


WIDE = "chr1\t1\t5" + "\tx" * 50_000


@pytest.mark.parametrize("text", ['"' * 99_999, "\t" * 50_000, "#" * 10, WIDE, WIDE[:-1] + '"', "chr1\t1\t5\t" + '"\t"\t' * 30_000, '"chr1' + "\t" * 30_000 + '"\t1\t5'])
@pytest.mark.parametrize("file", ["a", "b", "none"])
def test_hostile_long_lines(spark, text, file):
    lines = spark.createDataFrame([(1, file, 1, text, ""), (2, "a", 2, "chr1\t1\t5", ""), (3, "b", 2, "chr1\t1\t5\tq", "")], LINES)
    files = spark.createDataFrame([("a", "s", 3), ("b", "s", 4)], "file_name STRING, sample STRING, n_columns INT")
    sizes = spark.createDataFrame([("chr1", 10)], "seqname STRING, size_ BIGINT")
    got = {r["line_id"]: r["reason"] for r in parse_lines(lines, files, sizes).collect()}
    judged = brute(text, {"a": 3, "b": 4}.get(file))
    assert got == {2: None, 3: None} | ({} if judged is None else {1: judged[0] or None})
