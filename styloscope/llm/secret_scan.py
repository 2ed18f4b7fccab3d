"""Operator 13: secret scan with multipart credential linking.

Strong spans are reported wherever they are (whole matches, leftmost and non-overlapping for each kind):
- ``assign``: a password, secret, token or API key word, ``:`` or ``=``, and a value of eight characters or more;
- ``access``: an access key id of 16 characters or more; ``hex``: a run of 32 lower-case hex digits or more.

Weak candidates are common in clean text and are reported only beside complementary parts:
- ``id``: an access identifier (a named account, user, client or key id, or another access key prefix);
- ``key``: a named key or password with a short value or a vaguer name, or an opaque token of upper-case and lower-case
  letters and digits;
- ``endpoint``: a URL, or a named host or address.

Parts have a role (identifier: ``access``, ``id``; secret: ``assign``, ``hex``, ``key``; endpoint). A scope is what lies
within ``reach`` code points of a span in its paragraph (texts are cut at blank lines). A weak identifier or endpoint is
reported if a secret, strong or weak, is in its scope, a weak secret if an identifier or an endpoint is. This is an interval
join: each part's two edges are put in bins of the width of ``reach``, each candidate looks up the bins next to it on
either side, by (row, paragraph, side, bin), and the distance is tested on what meets there.

Scale: texts are read once, in one pass; what is written and joined are spans. A candidate has four look-ups and a part two
edges, and the join is a semi-join, so a document full of secrets yields no pairs. Documents without an identifier or
endpoint need no look at weak secrets, since none could be reported.

Edge cases: null and empty texts have no spans (the digest is that of the empty text); spans count code points, the end is
exclusive; a weak candidate that overlaps a strong span, or a weak one found before it, is dropped; rows are kept apart by a
stored row number, so null and repeated doc_ids and equal rows each have their own; an empty table has no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styloscope.llm.common import materialise, prepare, stream

KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
ROLE = {"access": "identifier", "id": "identifier", "assign": "secret", "hex": "secret", "key": "secret",
        "endpoint": "endpoint"}
SET = r"""["']?\x20*[:=]\x20*["']?"""

ASSIGN = re.compile(rf"(?i:password|passwd|secret|token|api_?key){SET}([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # a run is taken whole, so this drops the shorter ones

NAMED_ID = re.compile(rf"(?<![A-Za-z0-9])(?i:access_?key_?id|(?:client|account|tenant|key|user)_?id|user_?name|user|login|"
                      rf"account){SET}([A-Za-z0-9_.@+-]{{3,}})", re.A)
OTHER_ACCESS = re.compile(r"(?<![A-Z0-9])(?:ASIA|AROA|AIDA)[A-Z0-9]{12,}")
NAMED_KEY = re.compile(rf"(?<![A-Za-z0-9])(?i:(?:[a-z]+_)*(?:key|pass|pwd|auth|credentials?|signature)){SET}"
                       r"([A-Za-z0-9+/_.=-]{8,})", re.A)
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]+")
NAMED_HOST = re.compile(rf"(?<![A-Za-z0-9])(?i:host|host_?name|server|endpoint|base_?url|url|uri){SET}"
                        r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]{1,5})?)", re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")

PART = "struct<kind: string, start: int, end: int, paragraph: int>"


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strong spans."""
    lowered = text.encode().lower()
    out = []
    if any(word in lowered for word in (b"passw", b"secret", b"token", b"api")):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def _mixed(token: str) -> bool:
    return bool(re.search("[a-z]", token) and re.search("[A-Z]", token) and re.search("[0-9]", token))


def weak_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of weak candidates; none where no identifier or endpoint is, or no secret could be."""
    named = ":" in text or "=" in text
    endpoints = [("endpoint", *m.span()) for m in URL.finditer(text)] if "://" in text else []
    endpoints += [("endpoint", *m.span()) for m in NAMED_HOST.finditer(text)] if named else []
    ids = [("id", *m.span()) for m in NAMED_ID.finditer(text)] if named else []
    ids += [("id", *m.span()) for m in OTHER_ACCESS.finditer(text)]
    if not endpoints and not ids and not any(kind == "access" for kind, _, _ in strong):
        return []
    keys = [("key", *m.span()) for m in NAMED_KEY.finditer(text)] if named else []
    keys += [("key", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) < 8] if named else []
    keys += [("key", *m.span()) for m in OPAQUE.finditer(text) if _mixed(m[0])]
    taken, out = sorted((s, e) for _, s, e in strong), []
    for found in (endpoints, keys, ids):
        free = _disjoint(sorted(found, key=lambda x: (x[1], -x[2])), taken)
        taken = sorted(taken + [(s, e) for _, s, e in free])
        out += free
    return out


def _disjoint(found: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The spans, by start, that overlap neither one of ``taken`` (by start, possibly nested) nor one before them."""
    starts, furthest = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out, end = [], 0
    for kind, s, e in found:
        before = bisect_left(starts, e)  # those that start before this one ends
        if s >= end and not (before and furthest[before - 1] > s):
            out.append((kind, s, e))
            end = e
    return out


def spans_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, strong and weak spans (arrays of PART) of every row, written once; strong spans carry paragraphs too."""

    def scan(batches: Iterator[tuple]) -> Iterator[tuple]:
        for ids, texts in batches:
            for doc_id, text in zip(ids, texts):
                strong = strong_spans(text or "")
                weak = weak_spans(text or "", strong)
                cuts = [m.start() for m in BLANK.finditer(text)] if weak else []
                yield doc_id, _placed(strong, cuts), _placed(weak, cuts)

    found = stream(docs.select("doc_id", "text"), f"doc_id long, strong array<{PART}>, weak array<{PART}>", scan)
    return materialise(found.withColumn("row", F.monotonically_increasing_id()), "secret-spans")


def _placed(spans: list[tuple[str, int, int]], cuts: list[int]) -> list[dict]:
    return [{"kind": k, "start": s, "end": e, "paragraph": bisect_left(cuts, s)} for k, s, e in spans]


def role(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in ROLE.items() for x in pair]), kind)


def linked(spans: DataFrame, reach: int) -> DataFrame:
    """(row, kind, start, end) of the weak candidates that have a complementary part in their scope."""
    rows = spans.filter(F.size("weak") > 0)
    parts = rows.select("row", F.explode(F.concat("strong", "weak")).alias("x")).select(
        "row", "x.paragraph", role(F.col("x.kind")).alias("other"), F.explode(F.array(
            F.struct(F.lit("after").alias("side"), F.col("x.start").alias("edge")),
            F.struct(F.lit("before").alias("side"), F.col("x.end").alias("edge")))).alias("y"))
    edges = parts.select("row", "paragraph", "other", "y.side", "y.edge",
                         F.floor(F.col("y.edge") / reach).cast("int").alias("bin"))
    weak = rows.select("row", F.explode("weak").alias("x")).select("row", "x.*")
    ahead, behind = F.floor(F.col("end") / reach).cast("int"), F.floor(F.col("start") / reach).cast("int")
    looks = weak.select("row", "paragraph", "kind", "start", "end", role(F.col("kind")).alias("own"), F.explode(F.array(
        *[F.struct(F.lit(side).alias("side"), bin_.alias("bin"))
          for side, bin_ in (("after", ahead), ("after", ahead + 1), ("before", behind - 1), ("before", behind))]))
        .alias("y")).select("row", "paragraph", "kind", "start", "end", "own", "y.side", "y.bin")
    a, b = looks.alias("a"), edges.alias("b")
    gap = F.when(F.col("a.side") == "after", F.col("b.edge") - F.col("a.end")).otherwise(F.col("a.start") - F.col("b.edge"))
    complementary = (F.col("a.own") == "secret") != (F.col("b.other") == "secret")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("row", "paragraph", "side", "bin")]
    met = a.join(b, [*same, gap.between(0, reach), complementary], "left_semi")
    return met.select("row", "kind", "start", "end").distinct()


def written(spans: Column) -> Column:
    """``kind:start:end`` of each span by start, then kind as listed, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(order, x["kind"]).alias("k"),
                                                  x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def counted(kind: str) -> Column:
    return F.size(F.filter("strong", lambda x: x["kind"] == kind))


def scan_secrets(docs: DataFrame, reach: int = 300) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of ``docs``, and n_linked (weak spans reported)."""
    prepare(docs.sparkSession)
    spans = spans_of(docs)
    weak = linked(spans, reach).groupBy("row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    strong = F.transform("strong", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"),
                                                      x["end"].alias("end")))
    out = spans.join(weak, "row", "left").select(
        "doc_id", strong.alias("strong"),
        F.coalesce("linked", F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("linked"))
    counts = [counted(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]]
    return out.select("doc_id", *counts, F.sha2(written(F.col("strong")).cast("binary"), 256).alias("base_sha256"),
                      written(F.concat("strong", "linked")).alias("spans"), F.size("linked").cast("long").alias("n_linked"))
