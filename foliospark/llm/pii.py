"""PII surrogates: keyed, type-consistent replacements of detected entities.

An entity has a normal form: emails and names without case, phones, cards and
ibans without separators. Each kind of entity has a finite domain of its own
format (digits stay digits, vowels vowels, each in its script; card numbers keep
a valid or an invalid check digit; phones keep their country, addresses the block
that says their purpose; first names stay in their gender). Names are known by a title,
by a listed first name, or by what stands before them ("my name is"); a name
found so is found again where it stands alone in that text. In it a normal form x becomes P^-1(P(x) + 1) for a keyed
permutation P: one cycle over the domain. So the same entity has the same
surrogate everywhere (coreference), two entities never share one (distinctness),
and none is its own surrogate, without any table of entities. The surface's case
and separators are put back. What has a domain of one value becomes a keyed mask.

Who knows the key can undo surrogates, so it is an argument without a default.
``checked_surrogates`` holds the whole corpus against both promises: pairs of
normal form and surrogate are gathered from all texts and any clash is an error.

Scale: row by row, no shuffle; a worker caches recent entities. The check shuffles
distinct pairs alone, summed up before, so a frequent entity is no hot group.

Defined cases: a null text stays null. Other columns pass through as they are
(n_chars, if there, is counted anew). Every row counts on its own, ids may be null
or repeated. An empty table stays empty; texts of any length are read whole, in
time linear in their length.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import alone, by_place, in_slices, keeps, stored, unused

#: First names by gender and script.
FIRST_NAMES = {
    ("f", "latin"): "Anna Maria Julia Laura Sarah Emma Sophie Marie Claire Camille Lucia Carmen Elena Isabel Petra Sabine Ursula Heike Alice Emily Jane Mary Susan Linda Karen Nancy Agnieszka Katarzyna Małgorzata".split(),
    ("m", "latin"): "John James Robert Michael William David Thomas Peter Paul Mark Hans Klaus Jürgen Wolfgang Stefan Pierre Jean Louis Antoine Michel Carlos José Juan Miguel Pedro Luis Łukasz Krzysztof Tomasz".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Пётр".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία".split(),
    ("m", "greek"): "Γιώργος Δημήτρης Νίκος Κώστας".split(),
}
_TITLES = r"(?:Mrs?|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señora|Señor|Sra|Sr|Don|Doña)\.?"
_LETTERS = r"[^\W\d_]"
#: What stands before somebody's own name.
CUES = ("my name is", "name is", "Name:", "Author:", "signed by", "Signed:", "je m'appelle", "mon nom est", "Nom:", "ich heiße", "mein Name ist", "me llamo", "mi nombre es", "Nombre:", "меня зовут", "Имя:", "με λένε", "Όνομα:", "我叫", "姓名:", "姓名：")
#: Calling codes of one and of two digits; all others have three.
CODES = (*"17", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Address blocks of a purpose of their own, (first, bits).
BLOCKS = (("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.168.0.0", 16), ("224.0.0.0", 4), ("240.0.0.0", 4))
_SURNAME = rf"[^\W\d_a-z]{_LETTERS}*(?:['’-]{_LETTERS}+)+|[^\W\d_a-z]{_LETTERS}+"
_CUE = "(?:" + "|".join(sorted({w for c in CUES for w in (c, c[:1].upper() + c[1:])}, key=lambda c: (-len(c), c))) + ") *"
_NAMED = rf"[\u4e00-\u9fff]{{2,3}}(?![\u4e00-\u9fff])|(?:{_SURNAME})(?: (?:{_SURNAME})){{1,3}}"
_ALL_FIRST = frozenset(n.lower() for names in FIRST_NAMES.values() for n in names)
_FIRST = "|".join(sorted({w for names in FIRST_NAMES.values() for n in names for w in (n, n.upper())}, key=lambda n: (-len(n), n)))
#: Kind and regex, in order of precedence. No character may stand before a match that could be part of it, so a run is tried once.
KINDS = (
    ("email", r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[^\W_]|-)+(?:\.(?:[^\W_]|-)+)*\.[A-Za-z]{2,}(?![\w-])"),
    ("iban", r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?!\w)"),
    ("card", r"(?<![\w.])[3-6][0-9]{3}(?:[0-9]{9,12}|(?:[ -][0-9]{4}){3})(?![\w]|\.[0-9])"),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"),
    ("phone", r"(?<![\w+])\+[0-9]{1,3}(?:(?:[ .-]?(?:\([0-9]\)|[0-9](?=[ .-]))){0,2}[ .-]?\(?[0-9]{2,4}\)?){2,5}(?!\w)|(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])|(?<![\w+.-])0[0-9]{1,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])"),
    ("ipv6", r"(?<![\w:.])(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){7}(?![\w:])|(?<![\w:.])(?:[23][0-9A-Fa-f]{3}|[Ff][CcDdEe][0-9A-Fa-f]{2})(?::[0-9A-Fa-f]{1,4}){0,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?!\w|\.[0-9])"),
    ("titled", rf"(?<!\w){_TITLES} +(?:(?:{_FIRST}) +)?(?:{_SURNAME})(?!\w)"),
    ("named", rf"(?<!\w){_CUE}(?:{_NAMED})(?![^\W\u4e00-\u9fff])"),
    ("name", rf"(?<!\w)(?:{_FIRST}) +(?:{_SURNAME})(?!\w)"),
)


class Permutation:
    """A keyed permutation of 0..n-1: alternating Feistel rounds on a near-square, walked until the value falls inside."""

    def __init__(self, key: bytes, domain: str, n: int):
        self.n, self.a = n, max(1, int(n**0.5) if n < 2**50 else _isqrt(n))
        while self.a * self.a < n:
            self.a += 1
        self.b = -(-n // self.a)
        self.key = hashlib.blake2b(domain.encode(), key=key[:64], digest_size=32).digest()

    def _f(self, i: int, x: int) -> int:
        size = (self.n.bit_length() // 16 + 9) if self.n.bit_length() < 800 else 64
        return int.from_bytes(hashlib.blake2b(b"%d:%d" % (i, x), key=self.key, digest_size=min(64, size)).digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(6)) if back else range(6):
            sign = -1 if back else 1
            if i % 2:
                right = (right + sign * self._f(i, left)) % self.b
            else:
                left = (left + sign * self._f(i, right)) % self.a
        return left * self.b + right

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.n:
            x = self._once(x, back)
        return x

    def next(self, x: int) -> int:
        """The value after x on one keyed cycle through all n."""
        return self._walk((self._walk(x, False) + 1) % self.n, True)


def _isqrt(n: int) -> int:
    from math import isqrt

    return isqrt(n)


#: Alphabets within which letters may change: no vowel becomes a consonant, no script another.
_ALPHABETS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "àáâäèéêëìíîïòóôöùúûü", "ÀÁÂÄÈÉÊËÌÍÎÏÒÓÔÖÙÚÛÜ", "çñß", "ÇÑ", "аеиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕИОУЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ", "ς", "ΑΕΗΙΟΥΩ", "ΆΈΉΊΌΎΏ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ")
_CLASS = {c: a for a in _ALPHABETS for c in a}


@lru_cache(maxsize=20_000)
def _script(c: str) -> tuple | None:
    """Script, category, plane and normal form of a letter outside the listed alphabets."""
    if c in _CLASS or not c.isalpha():
        return None
    return unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), ord(c) >> 16, unicodedata.normalize("NFKC", c) == c


@lru_cache(maxsize=500)
def _letters(script: tuple) -> str:
    start = script[2] << 16
    return "".join(c for c in map(chr, range(start, start + 2**16)) if unicodedata.category(c) == script[1] and _script.__wrapped__(c) == script)


def _alphabet(c: str) -> str | None:
    if c in _CLASS:
        return _CLASS[c]
    script = _script(c)
    return _letters(script) if script else None


def _permute(key: bytes, domain: str, text: str, ok=None, fixed: int = 0, first: str = "") -> str:
    """Characters of ``text`` after the first ``fixed`` move within their alphabets; others stay. ok: a property all values of the domain share."""
    spots = [(i, first if first and text[i] in first and i == fixed else a) for i, c in enumerate(text) if i >= fixed and (a := _alphabet(c))]
    n = 1
    for _, a in spots:
        n *= len(a)
    if n == 1:
        return _mask(key, domain, text)
    shape = "".join("." if i >= fixed and _alphabet(c) else c for i, c in enumerate(text)) + "|" + "".join(a[0] for _, a in spots)
    p, x = Permutation(key, f"{domain}|{shape}", n), 0
    for i, a in spots:
        x = x * len(a) + a.index(text[i])
    while True:
        y = x = p.next(x)
        out = list(text)
        for i, a in reversed(spots):
            y, r = divmod(y, len(a))
            out[i] = a[r]
        if (made := "".join(out)) == text:  # nothing else in the domain will do
            return _mask(key, domain, text)
        if ok is None or ok(made):
            return made


def _block(n: int) -> tuple[int, int] | None:
    """(first, size) of the block of its own purpose that an address is in."""
    for first, bits in BLOCKS:
        start, size = int.from_bytes(bytes(map(int, first.split("."))), "big"), 2 ** (32 - bits)
        if start <= n < start + size:
            return start, size
    return None


def _next_address(key: bytes, n: int) -> int:
    """Another address of the same block, or another outside all of them."""
    if block := _block(n):
        return block[0] + Permutation(key, f"ip{block[0]}", block[1]).next(n - block[0])
    p = Permutation(key, "ip", 2**32)
    n = p.next(n)
    while _block(n):
        n = p.next(n)
    return n


def _code(phone: str) -> int:
    """Digits of the calling code."""
    return next((k for k in (1, 2) if phone[1 : 1 + k] in CODES), 3)


def _mask(key: bytes, domain: str, text: str) -> str:
    return f"[{domain}-{hashlib.blake2b(text.encode(), key=key[:64], digest_size=10).hexdigest()}]"


def luhn(text: str) -> bool:
    digits = [int(c) for c in reversed(text) if c.isdigit()]
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0


def _next_word(key: bytes, word: str) -> str:
    """The next first name of the same gender and script on a keyed cycle; other words move within their letters. Lower case."""
    for names in FIRST_NAMES.values():
        known = [n.lower() for n in names]
        if word in known:
            order = sorted(known, key=lambda n: hashlib.blake2b(n.encode(), key=key[:64]).digest())
            return order[(order.index(word) + 1) % len(order)]
    return _permute(key, "surname", word, lambda s: s not in _ALL_FIRST)


def _iban_ok(text: str) -> bool:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


#: What a phone number may hold besides its digits and plus; "(0)" is not dialled from abroad.
_TRUNK = re.compile(r"\(0\)")


def _lower(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else text


def normal(kind: str, text: str) -> str:
    """What spellings of one entity have in common."""
    if kind == "email":
        return text.lower()
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "card":
        return re.sub("[ -]", "", text)
    if kind == "phone":
        return re.sub(r"[^0-9+]", "", _TRUNK.sub("", text) if text.startswith("+") else text)
    if kind == "ipv6":
        return ipaddress.IPv6Address(text).compressed
    if kind in ("name", "titled", "named"):
        words = _bare(text).split() if kind == "named" else text.split()[kind == "titled" :]
        return " ".join(map(_lower, words))
    return text


def _bare(text: str) -> str:
    """A name without the cue before it."""
    return text[re.match(_CUE, text).end() :]


@lru_cache(maxsize=50_000)
def next_normal(key: bytes, kind: str, text: str) -> str:
    """The normal form that stands for another one."""
    if kind == "email":
        address, _, top = text.rpartition(".")
        return f"{_permute(key, 'email', address)}.{top}"
    if kind == "iban":
        good = _iban_ok(text)
        return _permute(key, f"iban{good}", text, lambda s: _iban_ok(s) == good, fixed=2)
    if kind == "card":
        good = luhn(text)
        return _permute(key, f"card{good}", text, lambda s: luhn(s) == good, fixed=1)
    if kind == "ip":
        n = int.from_bytes(bytes(map(int, text.split("."))), "big")
        return ".".join(map(str, _next_address(key, n).to_bytes(4, "big")))
    if kind == "ipv6":  # the first sixteen bits say what kind of address it is
        head, rest = divmod(int(ipaddress.IPv6Address(text)), 2**112)
        return ipaddress.IPv6Address(head * 2**112 + Permutation(key, f"ipv6{head}", 2**112).next(rest)).compressed
    if kind == "phone":  # the country, or the zero before an area, stays
        return _permute(key, "phone", text, fixed=1 + _code(text) if text.startswith("+") else int(text.startswith("0")))
    if kind in ("name", "titled", "named"):
        return " ".join(_next_word(key, w) for w in text.split(" "))
    return _permute(key, kind, text)


keeps(__name__, next_normal.cache_clear, _script.cache_clear, _letters.cache_clear)


def _cased(word: str, like: str) -> str:
    """A lower-case word in the case of another."""
    if len(word) == len(like):
        return "".join(u if b.isupper() and len(u := a.upper()) == 1 and u.lower() == a else a for a, b in zip(word, like, strict=True))
    return word.upper() if len(like) > 1 and like.isupper() else word[:1].upper() + word[1:] if like[:1].isupper() else word


def _spaced(made: str, like: str) -> str:
    """The characters of a normal form where those of a spelling stand, with its separators."""
    out, rest = [], iter(made)
    skip = {i for m in _TRUNK.finditer(like) for i in range(*m.span())} if like.startswith("+") else ()
    for i, c in enumerate(like):
        out.append(c if i in skip or not (c.isalnum() or c == "+") else next(rest))
    return "".join(out)


def surrogate(key: bytes, kind: str, text: str) -> str:
    made = next_normal(key, kind, normal(kind, text))
    if made.startswith("["):
        return made
    if kind == "email":
        return _cased(made, text)
    if kind in ("iban", "card", "phone"):
        return _spaced(made, text)
    if kind == "named":
        return text[: len(text) - len(_bare(text))] + surrogate(key, "name", _bare(text))
    if kind in ("name", "titled"):
        words, new = re.split(r"(\s+)", text), iter(made.split(" "))
        at = 2 if kind == "titled" else 0
        return "".join(w if i < at or i % 2 else _cased(next(new), w) for i, w in enumerate(words))
    return made


_ANY = re.compile("|".join(f"(?P<{kind}>{regex})" for kind, regex in KINDS))
#: A text without any of these has no entity.
_HINT = re.compile(rf"@|[0-9]{{3}}|[0-9]\.[0-9]|\+[0-9]|[A-Z]{{2}}[0-9]{{2}}|[23Ff][0-9A-Fa-f]{{3}}:|{_TITLES} |(?:{_FIRST}) |{_CUE}")


def _mentions(text: str, names: set[str], taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Where names that a cue gave stand elsewhere in the text, clear of what is taken (in order)."""
    import ahocorasick

    auto = ahocorasick.Automaton()
    for n in names:
        auto.add_word(n, len(n))
    auto.make_automaton()
    out, i, free = [], 0, 0
    for end, size in auto.iter_long(text):
        start, end = end - size + 1, end + 1
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        han = "\u4e00" <= text[start] <= "\u9fff"
        alone = han or not ((start and (text[start - 1].isalnum() or text[start - 1] == "_")) or (end < len(text) and (text[end].isalnum() or text[end] == "_")))
        if alone and start >= free and (i == len(taken) or end <= taken[i][0]):
            out.append((start, end, "name"))
            free = end
    return out


def replace(text: str, key: bytes) -> tuple[str, list[tuple[str, str, str, int]]]:
    """The text with surrogates, and (kind, original, surrogate, place in the result)."""
    if not _HINT.search(text):
        return text, []
    spans = [(m.start(), m.end(), m.lastgroup) for m in _ANY.finditer(text)]
    if names := {_bare(text[a:b]) for a, b, kind in spans if kind == "named"}:
        spans = sorted([*spans, *_mentions(text, names, spans)])
    out, found, last, size = [], [], 0, 0
    for start, end, kind in spans:
        new = surrogate(key, kind, text[start:end])
        out += [text[last:start], new]
        size += start - last
        found.append((kind, text[start:end], new, size))
        size, last = size + len(new), end
    return ("".join([*out, text[last:]]), found) if found else (text, [])


_AUDIT = (("kind", pa.string()), ("original", pa.string()), ("surrogate", pa.string()), ("start", pa.int32()), ("normal", pa.string()), ("becomes", pa.string()))


def with_surrogates(docs: DataFrame, key: bytes, audit: str | None = None) -> DataFrame:
    """docs with ``text`` replaced. audit names a further column, of entities array<struct<kind, original, surrogate, start, normal, becomes>>."""
    schema = docs.schema
    at = schema.names.index("text")
    kinds = T.ArrayType(T.StructType.fromDDL("kind string, original string, surrogate string, start int, normal string, becomes string"))
    made_of = T.StructType([*schema, *([T.StructField(audit, kinds)] if audit else [])])

    def run(batches):
        for b in in_slices(batches, 256, at):
            made = [replace(t, key) if t is not None else (None, []) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array([m[0] for m in made], pa.string())
            if audit:
                rows = [[dict(zip((n for n, _ in _AUDIT), (*f, x := normal(f[0], f[1]), next_normal(key, f[0], x)), strict=True)) for f in m[1]] for m in made]
                columns.append(pa.array(rows, pa.list_(pa.struct(_AUDIT))))
            yield pa.RecordBatch.from_arrays(columns, names=[str(i) for i in range(len(columns))])

    out = by_place(docs, alone(__name__, run), made_of)
    if "n_chars" in schema.names:
        out = out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType))
    return out


def collisions(audited: DataFrame, column: str) -> DataFrame:
    """Surrogates that stand for several entities, entities with several surrogates, and ones that are their own, over a whole corpus."""
    kind = F.when(F.col("e.kind").isin("titled", "named"), "name").otherwise(F.col("e.kind")).alias("kind")
    pairs = audited.select(F.explode(column).alias("e")).select(kind, "e.normal", "e.becomes").distinct()
    by = lambda one, other: pairs.groupBy("kind", F.col(one).alias("value")).agg(F.count(other).alias("n")).filter("n > 1")
    return by("becomes", "normal").unionByName(by("normal", "becomes")).unionByName(pairs.filter("normal = becomes").select("kind", F.col("normal").alias("value"), F.lit(1).cast("long").alias("n")))


def checked_surrogates(docs: DataFrame, key: bytes) -> tuple[DataFrame, str]:
    """with_surrogates, written and held against ``collisions``; and the name of the column of entities."""
    column = unused("_entities", docs)
    made = stored(with_surrogates(docs, key, column), "surrogates")
    if bad := collisions(made, column).take(5):
        raise ValueError(f"surrogates clash: {[r.kind for r in bad]}")
    return made, column
