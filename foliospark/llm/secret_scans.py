"""Secret scans with multipart credential linking, with DataFrame functions only.

Strong patterns are reported as they stand. Weak parts (account names, bare
tokens, endpoints, addresses) are reported only when a complementary part lies in
the same scope: an interval join of the parts of a text, where a scope reaches
SCOPE code points to either side. A weak account needs a secret near it, a weak
secret an account or an endpoint, an endpoint an account or a secret.

The interval join is a merge: part boundaries and the weak parts that ask are
sorted together, so what a weak part can meet stands within a bounded number of
places of it. A text costs n log n in its parts.

Scale: narrow, no shuffle, no Python. A text runs through an expensive pattern
only if a cheap gate finds its hallmark; every pattern is linear in the text.

Defined cases: null is the empty text. Every row is scanned on its own, whatever
its id; other columns are left out. A key block without an end goes as far as a key's letters do. Positions are code points, ends exclusive.
Texts of any length are scanned whole: key blocks, unbroken runs and tens of
thousands of parts in one text included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import let

SCOPE = 120
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A header, the two lines of an encrypted key, what a key's body is made of, and the end if it is there.
KEY_BLOCK = r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[\x20\x09-\x0D]*Proc-Type:[^\n]*)?(?:[\x20\x09-\x0D]*DEK-Info:[^\n]*)?[A-Za-z0-9+/=\x20\x09-\x0D]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
#: Kind, gate, regex, the least length and of which group, whether it is weak, role. The order is that of kinds in spans.
#: A loop over one character class is iterative in Java, one over a group nests a call for each turn. The runs of access
#: and hex are greedy, so asking for their least length in the regex finds the same matches as dropping short ones.
KINDS = (
    ("assign", r"(?i)password|passwd|secret|token|api_?key", ASSIGN, 6, 2, False, "secret"),
    ("access", "AKIA[A-Z0-9]{16}", "AKIA[A-Z0-9]{16,}", 20, 0, False, "account"),
    ("hex", "[0-9a-f]{24}", "[0-9a-f]{24,}", 24, 0, False, "secret"),
    ("private_key", "-----BEGIN ", KEY_BLOCK, 1, 0, False, "secret"),
    ("account", r"(?i)user|login|client_?id|account_?id", r"""(?i:user(?:_?name)?|login|client_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", 3, 0, True, "account"),
    ("bare", "[A-Za-z0-9+/_-]{32}", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{32,}={0,2}", 32, 0, True, "secret"),
    ("endpoint", "://", r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{0,15}://[^\x20\x09-\x0D\"'<>]+", 7, 0, True, "endpoint"),
    ("address", r"[0-9]\.[0-9]{1,3}\.[0-9]", r"(?<![0-9./@])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])", 7, 0, True, "endpoint"),
)
_SPAN = "struct<start:int,rank:int,end:int,kind:string,weak:boolean,role:string>"
_NONE = f"cast(array() as array<{_SPAN}>)"
#: Lengths are summed in chunks of so many, as a fold that appends copies what it has at each step.
_CHUNK = 512
#: Parts that can begin, and weak ones that can ask, within a scope: those of a kind don't overlap and have three characters at least.
_NEAR = 2 * len(KINDS) * (SCOPE // 3 + 2)


def _sums(lengths: Column, start: Column) -> Column:
    """start and the running sums after it."""
    return F.aggregate(lengths, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))


def running(lengths: Column) -> Column:
    """The running sums of a non-empty array of int."""
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _CHUNK).cast("int")), lambda k: F.slice(lengths, k * _CHUNK + 1, F.lit(_CHUNK)))
    total = lambda c: F.aggregate(c, F.lit(0), lambda s, n: s + n)
    each = lambda cs: F.zip_with(cs, F.slice(_sums(F.transform(cs, total), F.lit(0)), F.lit(1), F.size(cs)), lambda c, o: F.slice(_sums(c, o), F.lit(2), F.size(c)))
    return F.flatten(let(chunks, each))


def _matches(text: Column, kind: tuple, rank: int) -> Column:
    """Spans of the leftmost non-overlapping matches, from the pieces between them; too short ones are dropped."""
    name, gate, regex, least, group, weak, role = kind

    def spans(hits: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(regex), F.lit(group)) if group else hits
        sizes = F.zip_with(hits, parts, lambda h, p: F.struct(F.length(h).alias("hit"), F.length(p).alias("part")))
        ends = let(F.zip_with(F.slice(F.split(text, regex, -1), F.lit(1), F.size(hits)), hits, lambda g, h: F.length(g) + F.length(h)), running)
        span = lambda s, e: F.struct((e - s.hit).alias("start"), F.lit(rank).alias("rank"), F.when(s.part >= least, e).alias("end"), F.lit(name).alias("kind"), F.lit(weak).alias("weak"), F.lit(role).alias("role"))
        return F.filter(F.zip_with(sizes, ends, span), lambda s: s.end.isNotNull())

    found = let(F.regexp_extract_all(text, F.lit(regex), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(F.expr(_NONE)))
    return F.when(text.rlike(gate), found).otherwise(F.expr(_NONE))


def _asked(parts: Column, ahead: bool) -> Column:
    """Weak parts with a complementary part that begins within SCOPE after their end (ahead), or ends within SCOPE before their start.

    Positions count from the asking part outwards, so that both directions look at what follows in sorted order.
    """
    sign = 1 if ahead else -1
    mark = lambda p, asks: F.struct((sign * (p.end if asks is ahead else p.start)).alias("at"), F.lit(0 if asks else 1).alias("order"), p.alias("p"))
    marks = F.array_sort(F.concat(F.transform(F.filter(parts, lambda p: p.weak), lambda p: mark(p, True)), F.transform(parts, lambda p: mark(p, False))))
    wanted = lambda w, o: F.when(w.role == "account", o.role == "secret").otherwise(o.role != w.role)
    meets = lambda all_, m, i: (m.order == 0) & F.exists(F.slice(all_, i + 2, F.lit(_NEAR)), lambda o: (o.order == 1) & (o.at <= m.at + SCOPE) & wanted(m.p, o.p))
    return let(marks, lambda all_: F.transform(F.filter(all_, lambda m, i: meets(all_, m, i)), lambda m: m.p))


def _linked(parts: Column) -> Column:
    """Strong parts, and weak ones with a complementary part in scope that does not overlap them, in order."""
    kept = F.array_sort(F.concat(F.filter(parts, lambda p: ~p.weak), _asked(parts, True), _asked(parts, False)))
    first = lambda all_, p, i: (i == 0) | ~F.get(all_, i - 1).start.eqNullSafe(p.start) | ~F.get(all_, i - 1)["rank"].eqNullSafe(p["rank"])
    return F.when(F.exists(parts, lambda p: p.weak), let(kept, lambda all_: F.filter(all_, lambda p, i: first(all_, p, i)))).otherwise(F.array_sort(parts))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, found array<struct<start, rank, end, kind, weak, role>> in order of start, then kind."""
    text = F.col("text")
    parts = F.concat(*(_matches(text, kind, i) for i, kind in enumerate(KINDS)))
    any_gate = F.col("text").rlike("|".join(f"(?:{k[1]})" for k in KINDS))
    found = F.when(any_gate, let(parts, _linked)).otherwise(F.expr(_NONE))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", found.alias("found"))


def secret_digest(scanned: DataFrame) -> DataFrame:
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s.rank < 3)
    return scanned.select("doc_id", *(count(k[0]) for k in KINDS[:3]), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("found")).alias("spans"))
