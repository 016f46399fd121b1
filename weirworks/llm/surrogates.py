"""Surrogate generation for personal data.

Detected entities are replaced by values of the same type, script and format that a key decides: the same entity gets the
same surrogate everywhere (names also where the document repeats them without a title, in any case but with a capital at
the start), and different entities get different ones. Spark lists the distinct entities of the whole corpus, draws a
surrogate for each, and draws again, with the next attempt number, where two entities met on one surrogate or a surrogate
is a real entity of the corpus, until none is left. Documents without an entity keep their text as it is.

Texts are read whole. A null text stays null, an empty one empty; repeated rows are treated alike; a document's other
columns are untouched; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import sys
import unicodedata

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.sources.workdir import written

from .exchange import release

# Titles by gender, given names by gender and script, syllables of surnames by script.
MALE = "Mr Mister Sir Herr Monsieur M Señor Sr Don Господин".split()
FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mademoiselle Señora Sra Doña Госпожа".split()
NEUTRAL = "Dr Prof Доктор".split()
GIVEN = {
    ("m", "latin"): "Adam Ben Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Mario Nils Oscar Paul Ralf Simon Tom Victor".split(),
    ("f", "latin"): "Anna Bella Clara Diana Emma Flora Greta Helen Ida Julia Karin Laura Maria Nina Olga Paula Rosa Sara Tina Vera".split(),
    ("n", "latin"): "Alex Andrea Charlie Dominique Kim Luca Robin Sacha Toni Yannick".split(),
    ("m", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Иван Максим Олег Павел".split(),
    ("f", "cyrillic"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга Софья Юлия".split(),
    ("n", "cyrillic"): "Саша Женя Валя Шура".split(),
}
SYLLABLES = {"latin": "bar bel dor fen gar hol kam lin mor nel per ros sten tal ver wal".split(),
             "cyrillic": "бар вел дор гор кам лин мор нел пер рос тал".split()}

# Country codes of two digits; +1 and +7 have one, all others three.
CODES = set("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())

_TITLE = "|".join(sorted(MALE + FEMALE + NEUTRAL, key=len, reverse=True))
_KEYWORD = "password|passwd|pwd|secret|token|api[_-]?key|(?:access|secret|private)[_-]?key"
_GAP = r"[\ \u00a0\u202f.()/\u2010\u2011-]{0,3}"      # between the digits of an international number
_JOINT = "['’ʼ‐‑-]"         # inside of names
_NAME = rf"[^\W\d_](?:\w|{_JOINT}\w)(?:\w|{_JOINT}(?=\w))*"
_JOINTS = re.compile(_JOINT)
_MAIL = r"(?P<email>[\w.%+-]*\w@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,})"
_REST = rf"""
  (?:(?<![^\W_])|(?=[A-Z])(?<=[a-z]))(?=[apstAPSTſ])(?i:{_KEYWORD})["']?(?:[^\S\n]*|\s)[=:](?:[^\S\n]*|\s)
     (?:"(?P<double>(?:\\.|[^"\\\n])+)"|'(?P<single>(?:\\.|[^'\\\n]|'(?=\w))+)'(?!\w)|["']?(?P<word>[^\s"'`,;&<>()\[\]{{}}]*\w))
| (?<!\w)(?:
    (?=[A-Z])(?:(?P<iban>[A-Z]{{2}}\d{{2}}[A-Z0-9]{{11,30}}(?!\w)) | (?P<secret>AKIA[0-9A-Z]{{16}}(?!\w)))
  | (?P<hex>(?=[0-9a-fA-F]{{32}})(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{{32,}}(?!\w))
  | (?=[+\d(])(?<!\+)(?:
      (?P<world>\+(?:1(?:{_GAP}\d){{10}}|[1-9]\d{{9,14}}|[1-9](?:{_GAP}\d){{6,14}})(?!\d))
    | (?P<phone>(?:(?P<cc>\+\d{{1,3}})[ .-]?)?(?:\(\d{{3}}\)[ .-]?|\d{{3}}[ .-])\d{{3}}[ .-]\d{{4}}(?!\d)))
  | (?=\d)(?:
      (?P<ssn>(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?![\w-]))
    | (?P<card>(?<!\.)\d(?:[ -]?\d){{12,18}}(?!\w))
    | (?P<ip>(?<!\.)(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\w|\.\d)))
  | (?=[0-9a-fA-F:])(?P<ip6>(?:(?<!\.)[0-9a-fA-F]{{1,4}}:(?:(?:[0-9a-fA-F]{{1,4}}:){{6}}[0-9a-fA-F]{{1,4}}|(?:[0-9a-fA-F]{{1,4}}:){{0,6}}:(?:[0-9a-fA-F]{{1,4}}(?::[0-9a-fA-F]{{1,4}}){{0,6}})?)
      |(?<![.:])::[0-9a-fA-F]{{1,4}}(?::[0-9a-fA-F]{{1,4}}){{0,6}})(?!\w|:[\w:]|\.\d))
  | (?=[{"".join(sorted({t[0] for t in MALE + FEMALE + NEUTRAL}))}])(?P<title>{_TITLE})\.?\ (?P<name>{_NAME}(?:\ {_NAME})?))
"""
ENTITY = re.compile(f"{_MAIL}|{_REST}", re.X)
NO_MAIL = re.compile(f"(?P<email>(?!))|{_REST}", re.X)      # the same for texts without @, in less time
# What a text with an entity holds: a digit of any script, an @, AKIA, a key word, two colons, seven groups of an address, or
# a title and a blank. Digits are listed as Python knows them. Arrow's engine takes time in proportion to the text.
_DIGITS = "".join(f"\\x{{{z:x}}}-\\x{{{z + 9:x}}}" for z in range(128, sys.maxunicode) if chr(z).isdecimal() and unicodedata.decimal(chr(z)) == 0)
TRIGGER = rf"[@0-9{_DIGITS}]|::|(?::[a-fA-F]{{1,4}}){{7}}|AKIA|(?i:{_KEYWORD})|(?:{_TITLE})\.? "


def _script(text: str) -> str:
    return "cyrillic" if any("Ѐ" <= c <= "ӿ" for c in text) else "latin"


def _name(text: str) -> str:
    return re.sub("[‐‑]", "-", re.sub("[’ʼ]", "'", text.lower()))


def _repeats(text: str, names: dict[tuple[str, str], str], taken: list[tuple[int, int]]) -> list[tuple[int, int, str, str]]:
    """Places outside ``taken`` that repeat a name in any case but start with a capital; longer names first."""
    order = sorted(names, key=lambda n: (-len(n[1]), n))
    forms = ["|".join(re.sub(r"'|\\-", lambda j: "['’ʼ]" if j[0] == "'" else "[-‐‑]", re.escape(_JOINTS.sub(lambda j: "'" if j[0] in "'’ʼ" else "-", x)))
                      for x in dict.fromkeys((names[n], names[n].upper()))) for n in order]
    inside = {i for a, b in taken for i in range(a, b)}
    hits = []
    for m in re.finditer(rf"(?<!\w)(?:{'|'.join(f'({f})' for f in forms)})(?!\w)", text, re.I):
        if m.group()[0].isupper() and inside.isdisjoint(range(*m.span())):
            hits.append((*m.span(), *order[m.lastindex - 1]))
    return hits


def _address(text: str) -> str | None:
    """The 32 hex digits of an IPv6 address; none for one that is invalid, below ::1:0 or maybe a scope of code (a::b)."""
    try:
        value = ipaddress.IPv6Address(text)
    except ValueError:
        return None
    if int(value) >> 16 == 0 or not any(c.isdigit() for c in text) and len([x for x in text.split(":") if x]) < 3:
        return None
    return value.exploded.replace(":", "")


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the entities, left to right, none overlapping."""
    out, names = [], {}
    for m in (ENTITY if "@" in text else NO_MAIL).finditer(text):
        kind, value = m.lastgroup, m.group()
        if m["name"]:
            words, at = m["name"].split(" "), m.start("name")
            words = words if all(w[0].isupper() for w in words) else words[:1]
            if re.search("['’ʼ][sS]$", words[0]):           # Miller's car
                words = words[:1]
            words[-1] = re.sub("['’ʼ][sS]$", "", words[-1])
            if not words[0][0].isupper() or len(words[0]) < 2:
                continue
            gender = "m" if m["title"] in MALE else "f" if m["title"] in FEMALE else "n"
            for k, w in enumerate(words):
                kind = "family" if k == len(words) - 1 else "given_" + gender
                out.append((at, at + len(w), kind, _name(w)))
                names.setdefault((kind, _name(w)), w)
                led = next((j.start() for j in re.finditer("[‐‑-]", w) if w[j.end()].islower()), 0)
                if led:                                     # Miller-led: the name may end at the hyphen
                    names.setdefault((kind, _name(w[:led])), w[:led])
                at += len(w) + 1
            continue
        name = next((k for k in ("word", "double", "single") if m[k]), None)
        if name:
            value = m[name]
            if not any(c.isalnum() for c in value):
                continue
            known = re.fullmatch(r"(?=.*\d)[0-9a-fA-F]{32,}", value)
            out.append((m.start(name), m.end(name), "hex" if known else "secret", value.lower() if known else value))
            continue
        kind = next(k for k in ("email", "iban", "secret", "hex", "world", "phone", "ssn", "card", "ip", "ip6") if m[k])
        if kind == "ip6":
            if canonical := _address(value):
                out.append((m.start(), m.end(), kind, canonical))
            continue
        if kind == "world":                 # the national prefix in brackets is not part of the number
            digits = re.sub(r"\D", "", value.replace("(0)", ""))
            code = 1 if digits[0] in "17" else 2 if digits[:2] in CODES else 3
            out.append((m.start(), m.end(), "phone", f"+{digits[:code]}:{digits[code:]}"))
            continue
        if kind == "ip" and any(int(x) > 255 for x in value.split(".")):
            continue
        digits = re.sub(r"\D", "", value)
        canonical = {"email": value.lower(), "hex": value.lower(), "phone": f"{m['cc'] or ''}:{digits[len(m['cc'] or '+') - 1:]}",
                     "ssn": digits, "card": digits}.get(kind, value)
        out.append((m.start(), m.end(), kind, canonical))
    if names:                               # the same names without a title
        out = sorted(out + _repeats(text, names, [(a, b) for a, b, _, _ in out]))
    return out


def _luhn(digits: str) -> int:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10


def _drawn(char: str, n: int) -> str:
    """A character of the same class and script."""
    if char.isdigit():
        return str(n % 10)
    if not char.isalpha():
        return char
    low = char.lower()
    first, size = ("а", 32) if "Ѐ" <= low <= "ӿ" else ("α", 17) if "Ͱ" <= low <= "Ͽ" else ("a", 26)
    if ord(low) > 0x24f and first == "a":
        return chr((ord(char) & ~7) + n % 8)
    made = chr(ord(first) + n % size)
    return made.upper() if char.isupper() else made


def surrogate(kind: str, canonical: str, attempt: int, key: bytes) -> str:
    """The replacement in canonical form; the attempt changes it."""
    seed = hmac.new(key, f"{kind}\0{canonical}\0{attempt}".encode(), hashlib.sha256).digest()
    stream = hashlib.shake_256(seed).digest(2 * len(canonical) + 32)
    number = lambda i: int.from_bytes(stream[2 * i:2 * i + 2], "little")
    if kind.startswith("given") or kind == "family":
        made, used = [], 0
        for k, own in enumerate(_JOINTS.split(canonical)):             # O'Brien, Weber-Koch: part by part
            script = _script(own)
            if k and not own or len(own) == 1 and "'" in canonical:
                made.append(_drawn(own, number(used)) if own else "")
                used += 1
                continue
            parts = SYLLABLES[script]
            more = 2 + attempt // 4 if kind == "family" else 1 + (attempt + 2) // 4
            at = [number((used + i) % (len(stream) // 2)) for i in range(more)]
            if kind == "family":
                made.append("".join(parts[n % len(parts)] for n in at))
            else:
                names = GIVEN[kind[-1], script]
                made.append(names[at[0] % len(names)] + "".join(parts[n % len(parts)] for n in at[1:]))
            used += more
        joints = _JOINTS.findall(canonical)
        made = "".join(x + j for x, j in zip(made, [*joints, ""], strict=True))
        return made.lower()
    if kind == "hex":
        return "".join("0123456789abcdef"[number(i) % 16] for i in range(len(canonical)))
    if kind == "ip":
        own = canonical.split(".")
        fixed = 2 if own[:2] == ["192", "168"] else 1 if own[0] in ("10", "127") else 0
        return ".".join(own[:fixed] + [str(1 + number(i) % (222 if i == 0 else 254)) for i in range(fixed, 4)])
    if kind == "ip6":                      # groups keep their length, as long as there are enough of them; zero groups stay
        groups = [f"{int(canonical[i:i + 4], 16):x}" for i in range(0, 32, 4)]
        fixed = 4 if re.match("f[ef]", canonical) else 2 if re.match("f[cd]", canonical) else 1
        for g, own in enumerate(groups):
            if own != "0" and len(own) < 4 or own == "0" and attempt >= 16 and g > 3:
                own = "1" * min(4, len(own) + attempt // 4)
            made = "".join("0123456789abcdef"[number(4 * g + i) % 16] if i else "123456789abcdef"[number(4 * g) % 15] for i in range(len(own)))
            groups[g] = "0" if own == "0" else made
        made = "".join(x.zfill(4) for x in groups)
        return canonical[:fixed] + made[fixed:]
    if kind == "phone":
        area, digits = canonical.split(":")
        made = str(2 + number(0) % 8) + "".join(str(number(i) % 10) for i in range(1, len(digits)))
        return area + ":" + (made if attempt >= 8 or len(made) != 10 else made[:3] + "555" + made[6:])      # an exchange kept for fiction
    if kind == "card":
        made = canonical[0] + "".join(str(number(i) % 10) for i in range(1, len(canonical)))
        valid = _luhn(canonical) == 0
        last = next(d for d in "0123456789"[number(0) % 10:] + "0123456789" if (_luhn(made[:-1] + d) == 0) == valid)
        return made[:-1] + last
    if kind == "email":
        local, _, domain = canonical.partition("@")
        host, _, top = domain.rpartition(".")
        same = hashlib.shake_256(hmac.new(key, domain.encode(), hashlib.sha256).digest()).digest(len(host))     # one domain stays one
        host = "".join(_drawn(c, n) for c, n in zip(host.split(".")[0], same, strict=False))
        made = "".join(_drawn(c, number(i)) for i, c in enumerate(local)) + "".join(str(number(len(local) + i) % 10) for i in range(attempt // 4))
        return f"{made}@{host}.example.{top if top in ('com', 'net', 'org') else 'org'}"
    if canonical.startswith("AKIA"):
        return "AKIA" + "".join(_drawn(c, number(i)) for i, c in enumerate(canonical[4:]))
    if kind == "secret" and re.fullmatch("[0-9a-f]*[a-f][0-9a-f]*", canonical):
        made = "".join("0123456789abcdef"[number(i) % 16] for i in range(len(canonical)))
    else:
        made = "".join(_drawn(c, number(i)) for i, c in enumerate(canonical))
    return made + "".join(_drawn("a", number(len(canonical) + i)) for i in range(attempt // 4)) if kind == "secret" else made


def _styled(surface: str, kind: str, made: str) -> str:
    """The surrogate in the format of the text it replaces."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(made.replace("+", "").replace(":", ""))
        parts = re.split(r"(\(0\))", surface) if surface[0] == "+" else [surface]
        return "".join(p if p == "(0)" else "".join(next(digits) if c.isdigit() else c for c in p) for p in parts)
    if kind == "ip6":
        head, gap, tail = surface.partition("::")
        sides = [[x for x in side.split(":") if x] for side in (head, tail)]
        groups = [int(made[i:i + 4], 16) for i in range(0, 32, 4)]
        if any(groups[len(sides[0]):8 - len(sides[1])]):
            return str(ipaddress.IPv6Address(int(made, 16)))
        values = [groups[:len(sides[0])], groups[8 - len(sides[1]):]]
        out = gap.join([":".join(f"{v:x}".zfill(len(x)) for v, x in zip(v, x, strict=True)) for v, x in zip(values, sides, strict=True)][:2 if gap else 1])
        return out.upper() if surface.isupper() else out
    if kind in ("family", "email", "hex") or kind.startswith("given"):
        if surface.isupper():
            return made.upper()
        if kind not in ("email", "hex"):
            own, joints = _JOINTS.split(surface), [*_JOINTS.findall(surface), ""]
            return "".join((x.capitalize() if o[:1].isupper() else x) + j for x, o, j in zip(_JOINTS.split(made), own, joints, strict=True))
        return made.capitalize() if surface[:1].isupper() and surface[1:].islower() else made
    return made


def rewrite(text: str, made: dict[tuple[str, str], str]) -> str:
    out, at = [], 0
    for start, end, kind, canonical in find(text):
        if start >= at:
            out += [text[at:start], _styled(text[start:end], kind, made[kind, canonical])]
            at = end
    return "".join(out) + text[at:]


@F.arrow_udf(T.BooleanType())
def suspicious(texts: pa.Array) -> pa.Array:
    """Whether a text may hold an entity; every text that does passes."""
    return pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)


@F.arrow_udf(T.ArrayType(T.StructType().add("kind", T.StringType()).add("canonical", T.StringType())))
def _found(texts: pa.Array) -> pa.Array:
    shape = pa.list_(pa.struct([("kind", pa.string()), ("canonical", pa.string())]))
    suspects = pc.fill_null(pc.match_substring_regex(texts, TRIGGER), False)
    rows = [sorted({(k, c) for _, _, k, c in find(t.as_py())}) if s else [] for t, s in zip(texts, suspects.to_pylist(), strict=True)]
    release()
    return pa.array([[{"kind": k, "canonical": c} for k, c in r] for r in rows], shape)


@F.arrow_udf(T.StringType())
def _rewritten(texts: pa.Array, made: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), made.to_pylist(), strict=True)
    return pa.array([t if not m else rewrite(t, {(e["kind"], e["canonical"]): e["made"] for e in m}) for t, m in rows], pa.string())


def _draw(kind: Column, canonical: Column, attempt: Column, key: bytes) -> Column:
    @F.arrow_udf("string")
    def draw(kinds: pa.Array, values: pa.Array, attempts: pa.Array) -> pa.Array:
        return pa.array([surrogate(*x, key) for x in zip(kinds.to_pylist(), values.to_pylist(), attempts.to_pylist(), strict=True)], pa.string())
    return draw(kind, canonical, attempt)


def _one_kind(kind: Column) -> Column:
    """A given name is one entity, whatever title stood before it."""
    return F.when(F.startswith(kind, F.lit("given")), "given").otherwise(kind)


def distinct_surrogates(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, canonical, made): one surrogate for each distinct entity, no two alike, none a real entity of any kind.

    A given name is drawn from the list of the gender that its titles agree on over the whole corpus, else from a neutral one.
    """
    said = lambda kind: F.bool_or(F.col("kind") == kind)
    one = entities.groupBy(_one_kind(F.col("kind")).alias("one"), "canonical").agg(said("given_m").alias("m"), said("given_f").alias("f"))
    list_ = F.when(F.col("m") & ~F.col("f"), "given_m").when(F.col("f") & ~F.col("m"), "given_f").otherwise("given_n")
    one = one.select(F.when(F.col("one") == "given", list_).otherwise(F.col("one")).alias("kind"), "canonical", F.lit(0).alias("attempt"))
    state = written(one.withColumn("made", _draw(F.col("kind"), F.col("canonical"), F.col("attempt"), key)), "surrogates")
    while True:
        me = F.struct("kind", "canonical")
        shared = state.groupBy("made").agg(F.count(F.lit(1)).alias("n"), F.min(me).alias("first"))
        real = state.select(F.col("canonical").alias("made"), F.lit(True).alias("real")).distinct()
        judged = state.join(shared, "made").join(real, "made", "left")
        judged = judged.withColumn("again", F.col("real").isNotNull() | ((F.col("n") > 1) & (me != F.col("first"))))
        if judged.where("again").isEmpty():
            return state.select(_one_kind(F.col("kind")).alias("kind"), "canonical", "made")
        state = written(judged.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).select("kind", "canonical", "attempt").withColumn(
            "made", _draw(F.col("kind"), F.col("canonical"), F.col("attempt"), key)), "surrogates")


def default_key() -> bytes:
    return hashlib.sha256(b"surrogate key of the registered query; pass your own").digest()


def replace_entities(docs: DataFrame, key: bytes | None = None, counted: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text and any other columns) with surrogates in the texts; ``counted`` names a column for the number
    of distinct entities of the text, in the place of one that has the name already.

    Entities and texts meet by two hashes of the text, so rows need no key: rows with one text are treated alike, and
    neither null nor repeated ids bring rows together.
    """
    key = key or default_key()
    docs = docs.drop(counted) if counted else docs
    suspect = suspicious("text")
    named = docs.withColumns({"__one": F.xxhash64("text"), "__two": F.xxhash64(F.lit(2), "text")})
    rows = named.where(suspect)
    # all texts in one Python step, which looks at suspects only: a second worker for each core would hold its own memory
    found = named.select("__one", "__two", F.explode(_found("text")).alias("e")).select("__one", "__two", "e.kind", "e.canonical").distinct()
    found = written(found, "entities").withColumn("one", _one_kind(F.col("kind")))
    made = distinct_surrogates(found.select("kind", "canonical"), key).withColumnRenamed("kind", "one")
    maps = found.join(made, ["one", "canonical"]).groupBy("__one", "__two").agg(
        F.collect_list(F.struct("kind", "canonical", "made")).alias("__made"), F.count_distinct("one", "canonical").cast("int").alias("__n"))
    joined = rows.join(maps, ["__one", "__two"], "left")
    text = F.when(F.col("__made").isNull(), F.col("text")).otherwise(_rewritten("text", "__made"))
    changed = joined.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in docs.columns], *([F.coalesce("__n", F.lit(0)).alias(counted)] if counted else []))
    kept = docs.where(~suspect).select("*", *([F.lit(0).alias(counted)] if counted else []))
    return kept.unionByName(changed)
