"""Text expressions: regex dialect, token estimates, references and names."""

from __future__ import annotations

import re
from functools import reduce
from operator import add, and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: white space as the source rules understand it -------------
SPACE_CHARS = ("\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000\ufeff")
WIDE_SPACE = r"\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SPACE = r"\t\n\x0B\x0C\r " + WIDE_SPACE
NOT_EOL = r"[^\n\r\x{2028}\x{2029}]"


def not_space(also: str = "") -> str:
    """One character that is no white space and none of ``also``."""
    return f"[^{also}{SPACE}]"


# the same classes for Java, which tries the members of a class one after the other: most characters are found at once
QUICK = {not_space(also): rf"[{plain}[^\x00-\x7F{WIDE_SPACE}][\x00-\x08\x0E-\x1F\x7F]]" for also, plain in
         (("", "!-~"), ("`", "!-_a-~"), (r"\"'`", "#-&(-_a-~!"))}


class Rx:
    """One pattern, rendered for Spark (Java regex) or for a checker whose ``\\b`` is ASCII-only.

    Java's ``\\b`` looks at Unicode letters, the rules mean ASCII ones, so word edges are written as
    look-arounds.  Marks: ``{<}`` word start, ``{>}`` word end, ``{b}`` any word edge, ``{s}`` one white
    space character, ``{S}`` any other, ``{.}`` one character that does not end a line.  Two marks only speed
    Java up where they cannot change a match: ``{w}`` begins no word in its middle, ``{+}`` repeats a group
    without stepping back, which also keeps very long repeats off the stack.
    """

    def __init__(self, source: str, ignore_case: bool = False, needs: tuple[str, ...] = (), one_of: tuple[str, ...] = ()):
        self.source = source
        self.flags = "(?i)" if ignore_case else ""
        # plain strings that every match contains (one of the second): a quick search for them spares most texts the regex
        self.needs, self.one_of = needs, one_of

    def _common(self) -> str:
        return self.source.replace("{s}", f"[{SPACE}]").replace("{S}", not_space()).replace("{.}", NOT_EOL)

    @property
    def java(self) -> str:
        w, common = r"\w", self._common()       # ASCII in Java, and one look-up
        for plain, quick in QUICK.items():
            common = common.replace(plain, quick)
        return self.flags + (common.replace("{<}", f"(?<!{w})").replace("{>}", f"(?!{w})")
                             .replace("{b}", f"(?:(?<={w})(?!{w})|(?<!{w})(?={w}))")
                             .replace("{w}", r"(?:(?<![\w-])|\G)").replace("{+}", "++"))

    @property
    def ascii(self) -> str:
        return self.flags + (self._common().replace("{<}", r"\b").replace("{>}", r"\b").replace("{b}", r"\b")
                             .replace("{w}", "").replace("{+}", "+"))

    def worth(self, text: Column) -> Column | None:
        parts = [F.contains(text, F.lit(n)) for n in self.needs] + ([contains_any(text, list(self.one_of))] if self.one_of else [])
        return reduce(and_, parts) if parts else None

    def _guarded(self, text: Column, value: Column, default: Column) -> Column:
        worth = self.worth(text)
        return value if worth is None else F.when(worth, value).otherwise(default)

    def found(self, text: Column) -> Column:
        hit = F.rlike(text, F.lit(self.java))
        worth = self.worth(text)
        return hit if worth is None else worth & hit

    def count(self, text: Column) -> Column:
        return self._guarded(text, F.regexp_count(text, F.lit(self.java)), F.lit(0))

    def all(self, text: Column, group: int = 0) -> Column:
        none = F.array().cast("array<string>")
        return self._guarded(text, F.regexp_extract_all(text, F.lit(self.java), F.lit(group)), none)

    def first(self, text: Column, group: int = 0) -> Column:
        return self._guarded(text, F.regexp_extract(text, self.java, group), F.lit(""))


def one_of(words: list[str]) -> str:
    """Pattern of a word list that shares common beginnings, so that most positions fail on one character."""
    heads: dict[str, list[str]] = {}
    for word in sorted(set(words)):
        if word:
            heads.setdefault(word[0], []).append(word[1:])
    if not heads:
        return ""
    parts = [re.escape(head) + one_of(rests) for head, rests in heads.items()]
    body = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return f"(?:{body})?" if "" in words else body


def ahead(words: list[str], most: int = 4) -> str:
    """A look at the next characters that every place passes where a word begins, and few others: a class for each.

    Java tries all branches of a word list at every place; this spares it most of them.
    """
    width = min([most, *map(len, words)])
    classes = ["[" + "".join(map(re.escape, sorted({w[i] for w in words}))) + "]" for i in range(width)]
    return f"(?={''.join(classes)})" if classes else ""


class Words:
    """Whole-word alternatives over a lower-cased text and its list of key words.

    Plain words are looked up among the key words, which are cut out of the text once for all features; only
    alternatives of several words use a regex, and only on texts that hold their parts.
    """

    def __init__(self, *alternatives: str):
        self.plain = [a for a in alternatives if a.isalnum()]
        self.phrases = [Rx("{<}" + a + "{>}", needs=tuple(a.split("{.}*"))) for a in alternatives if not a.isalnum()]
        self.rx = Rx("{<}(?:" + "|".join(alternatives) + "){>}")

    def found(self, lowered: Column, words: Column) -> Column:
        hits = [rx.found(lowered) for rx in self.phrases]
        if self.plain:
            hits = [F.arrays_overlap(words, F.array(*[F.lit(w) for w in self.plain]))] + hits
        return reduce(or_, hits)

    def count(self, lowered: Column, words: Column) -> Column:
        """Occurrences; right as long as no alternative shares a word with another one."""
        counts = [rx.count(lowered) for rx in self.phrases]
        if self.plain:
            counts = [F.size(F.filter(words, lambda w: w.isin(self.plain)))] + counts
        return reduce(add, counts)


FEW_WORDS = 12     # so many plain searches cost less than the regex that they spare a text


def key_words(lowered: Column, *groups: Words) -> Column:
    """The words of a lower-cased text that any of the groups asks for, repeats kept."""
    wanted = sorted({w for g in groups for w in g.plain})
    found = F.regexp_extract_all(lowered, F.lit(Rx(ahead(wanted) + "{<}" + one_of(wanted) + "{>}").java), F.lit(0))
    if len(wanted) > FEW_WORDS:
        return found
    return F.when(contains_any(lowered, wanted), found).otherwise(F.array().cast("array<string>"))


def contains_any(text: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


# --- token estimates ---------------------------------------------------------

def units(text: Column) -> Column:
    """Length in UTF-16 units; texts of single-byte characters need no second encoding."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.length(text)).otherwise((F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int"))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(units(text) / F.lit(4.0)).cast("bigint")


def wide_spaces(text: Column) -> Column:
    """Whether a text holds white space that Java's short class does not know; few do."""
    return F.rlike(text, F.lit(f"[{WIDE_SPACE}]"))


def word_count(text: Column) -> Column:
    """Runs of characters other than white space."""
    return F.when(wide_spaces(text), Rx("{S}+").count(text)).otherwise(F.regexp_count(text, F.lit(r"\S+")))


def tokens_word(text: Column) -> Column:
    return F.ceil(word_count(text) * F.lit(1.3)).cast("bigint")


def tokens_char(text: Column) -> Column:
    return F.ceil(units(text) / F.lit(3.5)).cast("bigint")


def tokens_blended(text: Column) -> Column:
    return F.ceil(tokens_word(text) * F.lit(0.4) + tokens_char(text) * F.lit(0.6)).cast("bigint")


# --- file references ---------------------------------------------------------

# --- fixed values: how a prompt or an answer names a file ---
NAMED_FILE = Rx(r"{b}[\w/.-]+\.\w{1,5}{>}")
AT_MENTION = Rx(r"@[\w/.-]+", needs=("@",))
TICKED_FILE = Rx(r"`[^`]*\.\w{1,5}`", needs=("`", "."))
QUOTED_PATH = Rx(r"[\"'`](" + not_space(r"\"'`") + r"+\.\w{1,6})[\"'`]", needs=(".",))
BARE_PATH = Rx(r"(?:\./|{w}[\w-]+/){+}[\w.-]+\.\w{1,6}", needs=("/", "."))
TICKED_PATH = Rx(r"`(" + not_space("`") + r"+\.\w{1,6})`", needs=("`", "."))
FENCE = Rx(r"```\w*\n((?s:.*?))```", needs=("```",))
SUFFIXED = Rx(r"\.\w{1,5}{>}", needs=(".",))


def files_referenced(lowered: Column) -> Column:
    """How many distinct file-like names a lower-cased prompt mentions."""
    none = F.array().cast("array<string>")
    # every named file ends in a short suffix, which is far quicker to look for
    named = F.when(SUFFIXED.found(lowered), NAMED_FILE.all(lowered)).otherwise(none)
    return F.size(F.array_distinct(F.concat(named, AT_MENTION.all(lowered), TICKED_FILE.all(lowered))))


def file_refs(text: Column) -> Column:
    """Distinct paths named in a prompt: quoted, then bare, then back-ticked; first mention kept."""
    return F.array_distinct(F.concat(QUOTED_PATH.all(text, 1), BARE_PATH.all(text), TICKED_PATH.all(text, 1)))


def fenced_block(text: Column) -> Column:
    """Body of the first fenced code block, the empty string when there is none."""
    return FENCE.first(text, 1)


def code_of(text: Column) -> Column:
    """The first fenced block, or the whole text."""
    return F.when(FENCE.found(text), fenced_block(text)).otherwise(text)


def is_json(text: Column) -> Column:
    """Whether a text is exactly one JSON value.

    The parser stops after the first value, so the text is tried as the only element of an array and as the
    only field of an object: what follows a value fits one of them at most.
    """
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    in_object = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return in_array & in_object


# --- names and paths ---------------------------------------------------------

def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Last dot suffix of the base name; a leading dot does not start one."""
    return F.regexp_extract(base_name(path), r"^.+?(\.[^.]*)$", 1)


def short_model(name: Column) -> Column:
    return F.split_part(F.regexp_extract(name, "([^/]*)$", 1), F.lit(":"), F.lit(1))


def glob_to_regex(glob: str) -> str:
    """Anchored, case-insensitive pattern of a file glob with ``*`` and ``?``."""
    special = set(".+^${}()|[]\\")
    pieces = {"*": ".*", "?": "."}
    return "(?i)^" + "".join(pieces.get(c, "\\" + c if c in special else c) for c in glob) + "$"


# --- fixed values: hosts that count as local ---
URL_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
LOCAL_HOST = r"^(?:localhost$|127\.0\.0\.1$|192\.168\.|10\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def is_local_url(url: Column) -> Column:
    return F.coalesce(F.rlike(F.lower(F.regexp_extract(url, URL_HOST, 1)), F.lit(LOCAL_HOST)), F.lit(False))


def fingerprint(text: Column) -> Column:
    """Order-free 32-bit hash of the words of a prompt, in base 36."""
    lowered = F.lower(text)
    split = lambda space, word: F.regexp_extract_all(F.regexp_replace(lowered, f"[^a-z0-9{space}]+", ""), F.lit(word), F.lit(0))
    words = F.array_sort(F.when(wide_spaces(text), split(SPACE, Rx("{S}{3,}").java)).otherwise(split(r"\s", r"\S{3,}")))
    step = lambda h, c: F.pmod(h * F.lit(31) + F.ascii(c), F.lit(1 << 32))
    bits = F.aggregate(F.split(F.array_join(words, " "), ""), F.lit(0).cast("bigint"), step)
    size = F.when(bits >= (1 << 31), F.lit(1 << 32) - bits).otherwise(bits)
    return F.lower(F.conv(size.cast("string"), 10, 36))


# --- number formats ----------------------------------------------------------

def to_fixed(x: Column, digits: int) -> Column:
    """Decimal text of a non-negative double, rounded half up on its exact binary value."""
    whole = F.floor(x).cast("bigint")
    scaled = F.floor((x - F.floor(x)) * F.lit(float(1 << 62))).cast("bigint").cast("decimal(19,0)")
    unit = 10 ** digits
    doubled = scaled * F.lit(2 * unit).cast("decimal(6,0)") + F.lit(str(1 << 62)).cast("decimal(20,0)")
    part = F.call_function("div", doubled, F.lit(str(1 << 63)).cast("decimal(20,0)"))
    total = whole * F.lit(unit) + part
    if digits == 0:
        return total.cast("string")
    shown = F.floor(total / F.lit(unit)).cast("bigint").cast("string")
    rest = F.lpad((total % F.lit(unit)).cast("string"), digits, "0")
    return F.concat(shown, F.lit("."), rest)


def fmt_tokens(n: Column) -> Column:
    return (F.when(n >= 1_000_000, F.concat(to_fixed(n / F.lit(1e6), 1), F.lit("M")))
            .when(n >= 1_000, F.concat(to_fixed(n / F.lit(1e3), 1), F.lit("K")))
            .otherwise(F.floor(n + F.lit(0.5)).cast("bigint").cast("string")))


def fmt_cost(cost: Column) -> Column:
    return F.concat(F.when(cost >= 0, "$").otherwise("-$"), to_fixed(F.abs(cost), 2))


def fmt_duration(ms: Column) -> Column:
    return (F.when(ms >= 60000, F.concat(to_fixed(ms / F.lit(60000.0), 1), F.lit("m")))
            .when(ms >= 1000, F.concat(to_fixed(ms / F.lit(1000.0), 1), F.lit("s")))
            .otherwise(F.concat(ms.cast("string"), F.lit("ms"))))


def fmt_size(size: Column) -> Column:
    return (F.when(size < 1024, F.concat(size.cast("string"), F.lit("B")))
            .when(size < 1024 * 1024, F.concat(to_fixed(size / F.lit(1024.0), 1), F.lit("KB")))
            .otherwise(F.concat(to_fixed(size / F.lit(1048576.0), 1), F.lit("MB"))))


def time_ago(ts: Column, now: Column) -> Column:
    """Age of an event in words; ``now`` is a parameter, so results can be repeated."""
    sec = (F.unix_millis(now) - F.unix_millis(ts)) / F.lit(1000.0)
    part = lambda unit: F.floor(sec / F.lit(float(unit))).cast("string")
    return (F.when(sec < 60, "just now")
            .when(sec < 3600, F.concat(part(60), F.lit("m ago")))
            .when(sec < 86400, F.concat(part(3600), F.lit("h ago")))
            .otherwise(F.concat(part(86400), F.lit("d ago"))))
