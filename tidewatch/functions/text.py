"""Text expressions: severities, pattern dialect, display rows."""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession, functions as F

# The three severities, lowest first.
SEVERITIES = ("low", "medium", "high")


def severity(value: Column) -> Column:
    """Exactly `low`, `medium` or `high`; anything else counts as `low`."""
    return F.when(value.isin(*SEVERITIES), value).otherwise(F.lit("low"))


def severity_name(value: str | None) -> str:
    return value if value in SEVERITIES else "low"


# The letters beyond ASCII that fold to an ASCII letter.
_FOLDS = {"k": "\\u212A", "s": "\\u017F"}


def literal_pattern(keyword: str) -> str:
    """A Java pattern for `keyword` taken literally, in any letter case."""
    return "".join(_any_case(letter) for letter in keyword)


def _any_case(letter: str) -> str:
    if not letter.isascii():
        return f"(?iu:{letter})"
    if letter.isalpha():
        low = letter.lower()
        return f"[{low}{low.upper()}{_FOLDS.get(low, '')}]"
    return letter if letter.isspace() or letter.isdigit() else "\\" + letter


def may_contain(text: Column, keyword: str) -> Column:
    """True wherever `literal_pattern` matches, at the price of a plain search."""
    low = keyword.lower()
    if not low.isascii():
        return F.lit(True)
    found = F.lower(text).contains(low)
    return found | text.contains("\u017F") if "s" in low else found


_SPACE = r"\t\n\f\r "
_WORD = "0-9A-Za-z_"
_EDGE = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
_INNER = f"(?:(?<=[{_WORD}])(?=[{_WORD}])|(?<![{_WORD}])(?![{_WORD}]))"
_ESCAPES = {r"\s": f"[{_SPACE}]", r"\S": f"[^{_SPACE}]", r"\b": _EDGE, r"\B": _INNER,
            r"\v": r"\x0B"}
_CLASS_ESCAPES = {r"\s": _SPACE, r"\v": r"\x0B"}

_PROPERTY = r"\\[pP](?:\{\^?\w+\}|\w)"
_CODE = r"\\x(?:\{[0-9A-Fa-f]+\}|[0-9A-Fa-f]{2})|\\(?:0[0-7]{0,2}|[1-7][0-7]{1,2})"
_TOKENS = re.compile(
    rf"(?P<quote>\\Q.*?(?:\\E|\Z))|(?P<property>{_PROPERTY})|(?P<code>{_CODE})|(?P<escape>\\.)"
    r"|(?P<set>\[\^?\]?(?:\\.|\[:\^?\w+:\]|[^\]\\])*\])"
    r"|(?P<group>\((?:\?(?:P?<\w+>|[a-zA-Z\-]*[:)])?)?)|(?P<close>\))|(?P<branch>\|)"
    r"|(?P<repeat>(?:[*+?]|\{\d+(?:,\d*)?\})\??)"
    r"|(?P<other>.)", re.S)
_SET_TOKENS = re.compile(
    rf"(?P<property>{_PROPERTY})|(?P<code>{_CODE})|(?P<escape>\\.)|(?P<posix>\[:\^?\w+:\])"
    r"|(?P<other>.)", re.S)

#: How often a group that can match in several ways may be repeated.
LOOSE_REPEATS = 10
#: The largest count of a repeat, as in linear-time engines.
MOST_REPEATS = 1000


@dataclass
class _Item:
    """What a repeat applies to: it starts at `at` of the output.

    `member` is its text inside a class when it is one character; a group of several such branches
    has one, too. `steady` says that it always matches in one way and length, `nested` that a
    repeat over an unsteady group lies inside.
    """
    at: int
    member: str | None = None
    steady: bool = True
    nested: bool = False
    group: str = ""


@dataclass
class _Open:
    """A group that is not closed yet, with the flags around it."""
    at: int
    flags: str
    text: str
    branches: list[list[_Item]] = field(default_factory=lambda: [[]])


def java_pattern(pattern: str) -> str:
    """Rewrite a linear-time (RE2 style) pattern so that `rlike` matches the same text.

    Case folding becomes Unicode aware, `\\s`, `\\b` and `$` keep their narrow
    meaning, and constructs such engines refuse (look-around, back-references,
    possessive repeats) are refused here too.

    Spark's engine backtracks, and a repeated group with choices inside takes a stack frame for
    each round: a long text would end the job. So a repeated group of one-character branches becomes a
    class, and other groups with choices are refused beyond `LOOSE_REPEATS` rounds, or when nested.
    """
    return _Rewriter(pattern).result()


class _Rewriter:
    def __init__(self, pattern: str):
        self.pattern = pattern
        self.out: list[str] = []
        self.flags = ""
        self.open = [_Open(0, "", "")]
        self.repeatable = False

    def result(self) -> str:
        for token in _TOKENS.finditer(self.pattern):
            getattr(self, "_" + token.lastgroup)(token.group())
        if len(self.open) > 1:
            raise self._error("a group is not closed")
        return "(?d)" + "".join(self.out)

    def _error(self, why: str) -> ValueError:
        return ValueError(f"pattern {self.pattern!r}: {why}")

    def _add(self, text: str, **about) -> None:
        self.open[-1].branches[-1].append(_Item(len(self.out), **about))
        self.out.append(text)
        self.repeatable = True

    def _quote(self, text):
        for letter in text[2:].removesuffix("\\E"):
            self._literal(letter)

    def _literal(self, letter):
        text = letter if letter.isalnum() or not letter.isascii() or letter.isspace() else "\\" + letter
        self._add(text, member=text)

    def _property(self, text):
        self._add(_property(text), member=_property(text), steady=False)

    def _code(self, text):
        self._add(_code(text), member=_code(text))

    def _escape(self, text):
        java = _escape(text, _ESCAPES)
        if text[1] in "bBAz":
            self._add(java)
        else:
            # Characters of two lengths in UTF-16 are not steady.
            self._add(java, member=java, steady=text[1] not in "DWS")

    def _set(self, text):
        start = re.match(r"\[\^?\]?", text).group()
        inside = _SET_TOKENS.sub(_set_member, text[len(start):-1])
        if start.startswith("[^") and "[^" in inside:
            raise self._error(f"{text} is not supported")
        java = start.replace("]", r"\]") + inside + "]"
        narrow = all(ord(c) < 0x10000 for c in inside) and not re.search(r"\\[pPx]|\[\^|\\[DWS]", inside)
        self._add(java, member=java, steady=narrow and not start.startswith("[^"))

    def _group(self, text):
        flags = re.fullmatch(r"\(\?([imsU]*)(?:-([imsU]+))?([:)])", text)
        if text.startswith("(?") and flags is None and not text.endswith(">"):
            raise self._error(f"{text} is not supported")
        around = self.flags
        if flags is None:
            java = "("  # names are never read
        else:
            on, off = flags[1], flags[2] or ""
            self.flags = "".join(sorted((set(around) | set(on)) - set(off)))
            on, off = on.replace("U", "").replace("i", "iu"), off.replace("U", "")
            java = f"(?{on}{'-' + off if off else ''}{flags[3]}"
        if java == "(?)":
            java = ""
        if flags is not None and flags[3] == ")":
            self.out.append(java)
            self.repeatable = False
            return
        self.open.append(_Open(len(self.out), around, java))
        self.out.append(java)
        self.repeatable = False

    def _branch(self, text):
        self.open[-1].branches.append([])
        self.out.append(text)
        self.repeatable = False

    def _close(self, text):
        if len(self.open) == 1:
            raise self._error("a group is closed that was not opened")
        done = self.open.pop()
        self.flags = done.flags
        self.out.append(text)
        items = [item for branch in done.branches for item in branch]
        members = [b[0].member if len(b) == 1 else None for b in done.branches]
        several = len(done.branches) > 1
        self.open[-1].branches[-1].append(_Item(
            done.at, None if None in members else "".join(members),
            not several and all(i.steady for i in items), any(i.nested for i in items), done.text))
        self.repeatable = True

    def _repeat(self, text):
        items = self.open[-1].branches[-1]
        if not self.repeatable or not items:
            raise self._error(f"nested repeat {text}" if items else f"nothing to repeat by {text}")
        self.repeatable = False
        lazy = (len(text) > 1 and text.endswith("?")) != ("U" in self.flags)
        bare = text[:-1] if len(text) > 1 and text.endswith("?") else text
        least, most = _bounds(bare)
        if max(least, most or 0) > MOST_REPEATS or (most is not None and most < least):
            raise self._error(f"repeat {bare} is out of range")
        item = items[-1]
        many = most is None or most > 1
        nested = item.nested
        mark = "?" if lazy else ""
        if item.member is not None and (item.group and many or most is None and least > 1):
            inner = f"[{item.member}]"
            repeated = (f"{inner}{{{least}}}{inner}*{mark}" if most is None and least > 1
                        else inner + bare + mark)
            self.out[item.at:] = [f"{item.group or '(?:'}{repeated})"]
        else:
            if item.group and many and not item.steady:
                if most is None or most > LOOSE_REPEATS or item.nested:
                    raise self._error(
                        f"{bare} repeats a group that can match in several ways, which long texts "
                        f"do not survive; use a class, or at most {LOOSE_REPEATS} rounds")
                nested = True
            self.out.append(bare + mark)
        items[-1] = _Item(item.at, None, item.steady and least == most, nested, "")

    def _other(self, text):
        if text == "$":
            self._add("$" if "m" in self.flags else r"\z")
        elif text == "^":
            self._add(text)
        elif text == ".":
            self._add(text, member=r"\x{0}-\x{10FFFF}" if "s" in self.flags else r"[^\n]", steady=False)
        elif text in "[\\":
            raise self._error(f"a lone {text}")
        elif text in "{&":
            self._add("\\" + text, member="\\" + text)
        elif text in "-]}":
            self._add(text, member="\\" + text)
        else:
            self._add(text, member=text, steady=ord(text) < 0x10000)


def _bounds(repeat: str) -> tuple[int, int | None]:
    if not repeat.startswith("{"):
        return int(repeat == "+"), 1 if repeat == "?" else None
    least, comma, most = repeat.strip("{}").partition(",")
    return int(least), int(most) if most else None if comma else int(least)


def _code(text: str) -> str:
    """A character by its number, hexadecimal or octal."""
    value = int(text[2:].strip("{}"), 16) if text[1] == "x" else int(text[1:], 8)
    return r"\x{%x}" % value


def _escape(text: str, swaps: dict[str, str]) -> str:
    if text[1] in "123456789kGZXRhHVNcCeE":
        raise ValueError(f"{text} is not supported in a pattern")
    return swaps.get(text, text)


def _set_member(token: re.Match) -> str:
    kind, text = token.lastgroup, token.group()
    if kind == "property":
        return _property(text)
    if kind == "code":
        return _code(text)
    if kind == "escape":
        return f"[^{_SPACE}]" if text == r"\S" else _escape(text, _CLASS_ESCAPES)
    if kind == "posix":
        name = {"xdigit": "XDigit", "ascii": "ASCII"}.get(text.strip("[]:^"))
        name = name or text.strip("[]:^").capitalize()
        java = r"\w" if name == "Word" else r"\p{%s}" % name
        return java.replace("p", "P", 1).replace("w", "W", 1) if text[2] == "^" else java
    return "\\" + text if text in "[&" else text


def _property(text: str) -> str:
    name = text[2:].strip("{}")
    negated = (text[1] == "P") != name.startswith("^")
    name = name.lstrip("^")
    return "\\%s{%s%s}" % ("P" if negated else "p", "" if len(name) <= 2 else "Is", name)


def check_patterns(spark: SparkSession, patterns: list[str]) -> None:
    """Fail while the plan is built when a pattern does not compile."""
    spark.sql("SELECT 1").select(*[F.lit("").rlike(p) for p in patterns]).collect()


def display_text(value: Column, limit: int) -> Column:
    """One line of at most `limit` bytes; longer text keeps whole characters and ends in `…`."""
    head = F.replace(F.left(value, F.lit(limit - 1)), F.lit("\n"), F.lit(" "))
    lengths = F.sequence(F.lit((limit - 1) // 4), F.lit(limit - 1))
    cut = F.transform(F.array(head), lambda h: F.left(h, F.array_max(
        F.filter(lengths, lambda n: F.octet_length(F.left(h, n)) <= limit - 1))))
    return (F.when(F.octet_length(value) <= limit, F.replace(value, F.lit("\n"), F.lit(" ")))
            .otherwise(F.concat(F.when(F.octet_length(head) <= limit - 1, head)
                                .otherwise(F.get(cut, F.lit(0))), F.lit("…"))))
