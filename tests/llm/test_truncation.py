"""Truncated texts: made archives with known cuts, and the reading of endings."""

import base64
import random

import pytest

from intervane.llm.mail_ending import message_ending
from intervane.llm.tokens import encoder, token_counts
from intervane.llm.truncation import length_hazards, line_hazards, text_endings, truncated_texts, truncation_report

SCHEMA = "doc_id BIGINT, text STRING, source STRING, ending STRING, length INT"
HEAD = "From: Ada Lind <ada@x.example>\nTo: b@x.example\nSubject: runs\n\n"
WORDS = "signal track region window summit fragment barcode sequence coverage threshold archive table sample".split()


def message(rng, n):
    body = ""
    while len(body) < n:
        body += " ".join(rng.choice(WORDS) for _ in range(rng.randint(4, 12))).capitalize() + ". "
    return HEAD + body.strip() + rng.choice(["", "\n\nBest wishes\nAda Lind", "\n\nBest wishes\nAda Lind\n"])


def test_archives(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for i in range(1500):
        text = message(rng, rng.randint(100, 2600))
        source = rng.choice(["chars", "bytes", "free", "free"])
        if source == "bytes":
            text = text.replace("signal", "größe")
        whole = text
        if source == "chars":
            text = text[:1200]
        elif source == "bytes":
            text = text.encode()[:1500].decode(errors="ignore")
        elif rng.random() < 0.03:
            text = text[: rng.randint(len(HEAD) + 20, len(text) - 20)]
            text = text.rstrip(". ")
        if len(text.rstrip(". \n")) < len(whole.rstrip(". \n")):
            want.add(i)
        rows.append((i, text, source, "x", 1))
    rows += [(5000, None, "chars", "", 1), (5001, "", "free", "", 1), (5002, " \n", None, "", 1), (None, HEAD + "It ends here.", None, "", 1)]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = truncated_texts(frame).collect()
    assert len(got) == len(rows)
    found = {r["doc_id"] for r in got if r["truncated"]}
    assert len(found & want) >= 0.98 * len(want)
    assert len(found - want) <= 0.02 * len(want)
    limits = {(r["source"], r["measure"], r["length"]) for r in got if r["measure"]}
    assert {("chars", "chars", 1200), ("bytes", "bytes", 1500)} <= limits
    assert all((r["found_by"] == "limit") == (r["measure"] is not None) for r in got if r["truncated"])
    assert all(r["found_by"] is None for r in got if not r["truncated"])
    report = {r["source"]: r for r in truncation_report(frame).collect()}
    assert all(r["n_at_limit"] + r["n_broken_off"] == r["n_truncated"] for r in report.values())
    assert report["free"]["n_broken_off"] == report["free"]["n_truncated"] > 0
    assert report["free"]["n_at_limit"] == 0 and report["chars"]["rate"] > 0.3
    assert truncated_texts(frame.limit(0)).count() == 0


def test_marked_cuts_and_common_lengths(spark):
    """An archive that puts dots where it cuts has a limit; complete messages of one length, two of them broken off, have none."""
    rng = random.Random(5)
    rows, want = [], set()
    for i in range(600):
        text = message(rng, rng.randint(100, 2600))
        if len(text) >= 1000:
            text = text[:997] + "..."
            want.add(i)
        rows.append((i, text, "dots", "", 1))
    for i in range(600, 900):
        text = message(rng, rng.randint(100, 2600))
        rows.append((i, text, "jobs", "", 1))
    for i in range(900, 909):
        job = f"Job {i} ended"
        rows.append((i, HEAD + job + "." * (i < 907) + " All of it was written." * (i < 907) + "q" * (24 if i >= 907 else 0), "jobs", "", 1))
    rows.append((999, HEAD + "I wonder whether it holds...", "dots", "", 1))
    got = {r["doc_id"]: r for r in truncated_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len({len(r[1]) for r in rows if 900 <= r[0] < 909}) == 1
    assert {i for i in got if i < 600 and got[i]["truncated"]} == want
    assert got[999]["ending"] == "marked" and not got[999]["truncated"]
    assert all(got[i]["measure"] is None for i in got if i >= 600)
    assert [i for i in range(900, 909) if got[i]["truncated"]] == [907, 908]


def test_hazards_by_hand(spark):
    rows = [(i, 100 + i % 40, "a") for i in range(400)] + [(1000 + i, 120, "a") for i in range(200)]
    lengths = spark.createDataFrame(rows, "doc_id BIGINT, chars INT, source STRING").selectExpr("*", "chars AS bytes", "chars AS body_chars", "chars AS body_bytes")
    got = {r["length"]: r for r in length_hazards(lengths).filter("measure = 'chars'").collect()}
    assert [x for x in got if got[x]["significant"]] == [120]
    assert got[120]["n"] == 210 and got[120]["at_risk"] == 400
    assert got[120]["hazard"] == pytest.approx(210 / 400)
    assert got[120]["expected"] == pytest.approx((390 + 0.5) / 100 / 400)
    assert got[139]["at_risk"] == 10 and got[139]["p"] == 1.0 or got[139]["p"] > 0.001


MIME = 'Content-Type: multipart/mixed; boundary="=_b1"\n\n--=_b1\nContent-Type: text/plain\n\nHello\n\n'
B64 = MIME + '--=_b1\nContent-Type: application/pdf\nContent-Transfer-Encoding: base64\n\n'


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "empty"),
        ("", "empty"),
        ("\n \n", "empty"),
        ("Subject: x\nMess", "broken"),
        ("no header here", "text"),
        (HEAD + "words go on and", "text"),
        (HEAD + "the text [...]", "closed"),
        (HEAD + "caf�", "broken"),
        (MIME + "--=_b1--\n", "closed"),
        (MIME + "--=_b", "broken"),
        (MIME + "--=_b1\nContent-Type: te", "broken"),
        (MIME, "text"),
        (B64 + "AAAA\nAAA", "broken"),
        (B64 + "AAAA\nAA==\n\n--=_b1--", "closed"),
        (B64 + "AAAAAAAA\nAAAAAAAA", "broken"),
        ("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode(b"all is said.").decode(), "text"),
        ("Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("größe".encode())[:4].decode(), "broken"),
        ("Content-Transfer-Encoding: quoted-printable\n\ngr=C3=B6=C3", "broken"),
        ("Content-Transfer-Encoding: quoted-printable\n\nends so=", "broken"),
        ("Content-Transfer-Encoding: quoted-printable\n\nends=20so", "text"),
        ("Content-Type: text/html\n\n<html><body><p>Hi</p></body></html>\n", "closed"),
        ("Content-Type: text/html\n\n<html><body><p>Hi<b", "broken"),
        (HEAD + "x" * 2_000_000, "text"),
    ],
)
def test_endings(text, state):
    assert message_ending(text)[0] == state


def test_decoded_last_line():
    packed = base64.b64encode("Guten Tag\nViele Grüße".encode()).decode()
    assert message_ending("Content-Transfer-Encoding: base64\n\n" + packed) == ("text", "Viele Grüße")
    assert message_ending("Content-Transfer-Encoding: quoted-printable\n\nViele Gr=C3=BC=\n=C3=9Fe\n") == ("text", "Viele Grüße")


def test_known_lines(spark):
    rows = [(i, HEAD + f"Text {i}.\n\nAll the best\n", "s", "", 1) for i in range(4)] + [(9, HEAD + "Text.\n\n> All the best", "s", "", 1), (10, HEAD + "Text.\n\nAda Lind", "s", "", 1), (11, HEAD + "Text.\n\nAll the", "s", "", 1)]
    got = {r["doc_id"]: r["ending"] for r in text_endings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[i] for i in (0, 9, 10, 11)] == ["known", "known", "known", "open"]


@pytest.mark.parametrize("size", [40, 400])
def test_wrapped_fragments_excuse_no_cut(spark, size):
    rows = [(i, HEAD + f"Text {i} shows\nthe\nsummit of all.\n" + "\nAll the best\n" * (i % 4 == 0), "s", "", 1) for i in range(size)]
    rows += [(9000, HEAD + "Text shows\nthe", "s", "", 1), (9001, HEAD + "Text.\n\nAll the best", "s", "", 1)]
    got = {r["doc_id"]: r["ending"] for r in text_endings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[9000], got[9001]) == ("open", "known")


@pytest.mark.parametrize("times", [1, 20])
def test_line_hazards_at_any_size(spark, times):
    """A greeting is significant, a fragment of wrapped lines is not, however large the archive; the counts are those made by hand."""
    wrapped = "these lines of the message were broken by a program that wraps them"
    rows = [(i, HEAD + f"{wrapped}\n" * 9 + "and the\n" + f"{wrapped}\n" * 3 + ("and the\n\n" if i == 0 else "") + "Text.\n\nAll the best\n", "s", "", 1) for i in range(30 * times)]
    got = {r["known"]: r for r in line_hazards(spark.createDataFrame(rows, SCHEMA)).collect()}
    best, part = got["all the best"], got["and the"]
    assert (best["n"], best["at_risk"], best["significant"]) == (30 * times, 30 * times, True)
    assert (part["n"], part["at_risk"], part["significant"]) == (1, 30 * times + 1, False)
    assert line_hazards(spark.createDataFrame([], SCHEMA)).count() == 0


def test_tokens(spark):
    texts = [(1, "Hello world"), (2, None), (3, ""), (4, "größe\n\n 日本語 <|endoftext|>" * 50)]
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts(spark.createDataFrame(texts, "doc_id BIGINT, text STRING"), ["doc_id"]).collect()}
    assert got == {i: len(encoder().encode_ordinary(t or "")) for i, t in texts}
    assert got[1] == 2
