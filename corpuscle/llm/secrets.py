"""Secret scans with multipart credential linking.

Base findings are kept always. Beside them a text has weak parts: access identifiers, secrets and endpoints that alone are
no finding. Parts are intervals of a scope (a run of text without a blank line), and an interval join links each part with
the parts of complementary roles in the same scope, however long that is (a caller may bound the distance by `window`, in code
points). A weak part is reported only
where complementary parts co-occur: a secret with an identifier or an endpoint, an identifier or an endpoint with a secret.
Base findings take part in the join (access as an identifier, assign and hex as secrets). The join is a merge over sorted
starts with binary search, so a text with many parts costs n log n and gives each part once, never all pairs.

Scale: documents are independent, no shuffle; each step holds about 4 MB of text.

Defined results: null and empty texts have no spans; kinds may overlap one another, as the base rules say; weak parts that
overlap a base span are left out; rows that repeat are repeated, and a null doc_id is one like any other; a text of any length is
scanned whole, in memory at once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import _base

# The base rules.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
#: The same matches as HEX with its least length, without a match for every letter of a prose text.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
BASE = KINDS[:3]
#: Bits a character that a bare token needs to be a weak secret.
ENTROPY = 3.2

#: Names may have a prefix that ends in _ or -, as in DB_USER; no letter or digit stands before them.
IDENTIFIER = re.compile(r"""(?<![A-Za-z0-9])(?:access[_-]?key[_-]?id|client[_-]?id|account[_-]?id|user(?:[_-]?name)?|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9._@-]{3,})""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(
    r"""\b(?:https?|ftp|sftp|ssh|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host(?:[_-]?name)?|endpoint|server|bucket|database[_-]?url)["']?\x20*[:=]\x20*["']?([A-Za-z0-9.:/_-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
NAMED_SECRET = re.compile(r"""(?<![A-Za-z0-9])(?:pass|pwd|pin|key|private[_-]?key|auth|credentials?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=!@#$%^&*-]{4,})""", re.IGNORECASE | re.ASCII)
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
SCOPE_END = re.compile(r"\n[ \t\r]*\n")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that are long enough."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), "hex") for m in LONG_HEX.finditer(text)]
    return out


def _dense(token: str) -> bool:
    """Letters and digits, and enough entropy for a random token."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * log2(k / n) for k in Counter(token).values()) >= ENTROPY


def weak_parts(text: str) -> list[Span]:
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "identifier") for m in IDENTIFIER.finditer(text)]
        out += [(m.start(), m.end(), "endpoint") for m in ENDPOINT.finditer(text)]
        out += [(m.start(), m.end(), "weak_secret") for m in NAMED_SECRET.finditer(text)]
    return out


def bare_secrets(text: str) -> list[Span]:
    return [(m.start(), m.end(), "weak_secret") for m in BARE_SECRET.finditer(text) if _dense(m[0])]


class Role:
    """Sorted spans of one role, ready for the join."""

    def __init__(self, spans: list[Span]):
        spans = sorted(spans)
        self.starts = [s for s, _, _ in spans]
        #: The largest end so far.
        self.reach: list[int] = []
        for _, end, _ in spans:
            self.reach.append(max(end, self.reach[-1]) if self.reach else end)

    def near(self, part: Span, breaks: list[int], window: int | None) -> bool:
        """Whether a span lies in the part's scope, and within `window` of the part if that is given."""
        k = bisect_right(breaks, part[0])
        low = breaks[k - 1] + 1 if k else 0
        k = bisect_left(breaks, part[1])
        high = breaks[k] - 1 if k < len(breaks) else sys.maxsize
        if window is not None:
            low, high = max(low, part[0] - window), min(high, part[1] + window)
        first = bisect_left(self.reach, low)
        return first < len(self.starts) and self.starts[first] <= high


def complements(text: str, base: list[Span]) -> tuple[list[Span], dict[str, tuple[Role, ...]]]:
    """The weak parts outside base spans, and the roles that complete each kind; no parts where no link is possible."""
    weak = weak_parts(text)
    if not any(s[2] in ("identifier", "endpoint") for s in weak) and not any(s[2] == "access" for s in base):
        return [], {}
    weak += bare_secrets(text)
    covered = Role(base)

    def free(part: Span) -> bool:
        k = bisect_left(covered.starts, part[1]) - 1
        return k < 0 or covered.reach[k] <= part[0]

    weak = [p for p in weak if free(p)]
    keys = Role([s for s in weak if s[2] == "identifier"] + [s for s in base if s[2] == "access"])
    points = Role([s for s in weak if s[2] == "endpoint"])
    secrets = Role([s for s in weak if s[2] == "weak_secret"] + [s for s in base if s[2] != "access"])
    return weak, {"weak_secret": (keys, points), "identifier": (secrets,), "endpoint": (secrets,)}


def link(text: str, base: list[Span], window: int | None = None) -> list[Span]:
    """The weak parts that have a complement in their scope."""
    weak, wanted = complements(text, base)
    breaks = [m.start() for m in SCOPE_END.finditer(text)] if weak else []
    return [p for p in weak if any(role.near(p, breaks, window) for role in wanted[p[2]])]


def find(text: str | None, window: int | None = None) -> list[Span]:
    """All spans, by start, then kind, then end."""
    text = text or ""
    base = base_spans(text)
    return sorted([*base, *set(link(text, base, window))], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def scan_secrets(docs: DataFrame, window: int | None = None) -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end>> in code points, end exclusive."""
    cell = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _base.steps(batches):
            got = [[{"kind": k, "start": s, "end": e} for s, e, k in find(t, window)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(got, pa.list_(cell))], ["doc_id", "spans"])

    return _base.texts(docs).mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_base.table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(base, 256).alias("base_sha256"), joined("spans").alias("spans"), (F.size("spans") - F.size(F.filter("spans", lambda s: s["kind"].isin(*BASE)))).cast("long").alias("n_linked"))
