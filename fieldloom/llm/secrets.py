"""Secret scans that link the parts of multipart credentials.

Certain kinds stand on their own: ``assign`` (a keyword, a separator and a
value), ``access`` (access key ids) and ``hex`` (long hexadecimal runs).
Other parts are weak alone: ``opaque`` tokens that look random, ``user``
names being assigned, and ``endpoint`` addresses. Parts of one text are joined
when the gap between them is at most ``SCOPE`` code points; a weak part is
reported only if complementary parts are in reach: an opaque token with an
access id, user or endpoint; a user or endpoint with a secret. Each reported
weak part names its nearest partner, so the output is linear in the text.

Defined cases: a null text is an empty one and gives a row without findings,
as does any text without any; offsets are code points of the whole text, end
exclusive. Null and repeated ids are rows like any other.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import read

#: The base kinds, in the order in which they are listed.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "opaque", "user", "endpoint")

OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
USER = re.compile(r"(?:user(?:_?name)?|login|client_?id|account_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@+-]{3,})", re.I | re.A)
ENDPOINT = re.compile(r"(?:https?|ftp|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?&=%+-]{4,}")
#: Gap in code points within which parts belong together.
SCOPE = 200
#: Bits per character that an opaque token must have.
ENTROPY = 3.5


def _random_looking(s: str) -> bool:
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def _nearest(parts: list[tuple[int, int, str]], others: list[tuple[int, int, str]], scope: int) -> Iterator[tuple[tuple[int, int, str], tuple[int, int, str]]]:
    """Each part, by start, with the other of the smallest gap to it if that is within ``scope``.

    One sweep: of the others that start before a part only the one that
    reaches farthest can be nearest, of those that start after it only the
    first, and at its own start there is at most one of each kind.
    """
    i, far = 0, None
    for part in sorted(parts):
        while i < len(others) and others[i][0] < part[0]:
            if far is None or others[i][1] > far[1]:
                far = others[i]
            i += 1
        near, j = [far] if far else [], i
        while j < len(others) and others[j][0] == part[0]:
            near.append(others[j])
            j += 1
        near = [x for x in [*near, *others[j : j + 1]] if x[:2] != part[:2]]
        gap = lambda x: max(x[0] - part[1], part[0] - x[1], 0)  # noqa: B023, E731
        best = min(near, key=lambda x: (gap(x), x), default=None)
        if best and gap(best) <= scope:
            yield part, best


def find(text: str, scope: int = SCOPE) -> list[tuple[str, int, int, int | None, int | None]]:
    """Findings ``(kind, start, end, partner's start, partner's end)`` by start, then kind as listed."""
    assign = [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    access = [(*m.span(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18] if "AKIA" in text else []
    hexes = [(*m.span(), "hex") for m in HEX.finditer(text)]
    out = [(k, s, e, None, None) for s, e, k in assign + access + hexes]
    users = [(*m.span(), "user") for m in USER.finditer(text) if len(m[1]) >= 3]
    ends = [(*m.span(), "endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    if access or users or ends:
        base = sorted(assign + access + hexes)
        taken, reach = [], 0  # base spans and how far those before reach: opaque tokens within them aren't new
        for s, e, _ in base:
            reach = max(reach, e)
            taken.append(reach)
        starts = [s for s, _, _ in base]
        opaque = []
        for m in OPAQUE.finditer(text):
            i = bisect.bisect_left(starts, m.end()) - 1
            if (i < 0 or taken[i] <= m.start()) and _random_looking(m[0]):
                opaque.append((*m.span(), "opaque"))
        owners = sorted(access + users + ends)
        secrets = sorted(assign + hexes + opaque)
        for group, partners in ((opaque, owners), (users, secrets), (ends, secrets)):
            out += [(kind, s, e, near[0], near[1]) for (s, e, kind), near in _nearest(group, partners, scope)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


_FINDINGS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("partner_start", pa.int64()), ("partner_end", pa.int64())]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, *keep, findings)`` for each row; findings are structs of kind, start, end and the partner's span."""
    cols = docs.select(F.col(id_col).alias("doc_id"), *keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[dict(zip(("kind", "start", "end", "partner_start", "partner_end"), f, strict=True)) for f in find(t, scope)] for t in b["__text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(rows, _FINDINGS)], names=[*b.schema.names[:-1], "findings"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema.fields[:-1])
    return cols.mapInArrow(run, f"{kinds}, findings array<struct<kind:string,start:long,end:long,partner_start:long,partner_end:long>>")


def redacted(text: str, scope: int = SCOPE) -> str:
    """The text with each finding's span replaced by its kind in brackets; spans that overlap become one."""
    out, at = [], 0
    for kind, start, end, _, _ in find(text, scope):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(text: Column, scope: int = SCOPE) -> Column:
    """``redacted`` of a column; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([None if (t := x.as_py()) is None else redacted(t, scope) for x in b], pa.string())

    return run(text)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of all findings, for each document."""
    f = scan(read(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long")
    show = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("findings", lambda x: x["kind"].isin("assign", "access", "hex"))
    return f.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(F.array_join(F.transform(base, show), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("findings", show), ",").alias("spans"),
    )
