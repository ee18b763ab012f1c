"""Secrets in text, on built-in expressions only.

Three patterns give the base spans: assignments to secret-like names, access key ids, and long runs of
hex digits. On top, every long run of one character class (hex or base64 characters) is a candidate:
a window slides over it, the count of each character is kept up to date as one enters and one
leaves, and the windows whose Shannon entropy reaches the class's threshold make up spans. Windows that are
on the allow-list (words, slugs and paths, plain numbers) or touch something that is (UUIDs, alphabets in
order, placeholders) are passed over, whatever else the run holds. Spans are code points with the end exclusive.

Edge cases: null text is empty, and an empty text has no span; every row keeps its row, ids that are
null or repeated included; an empty table gives an empty result. Nothing is shuffled, so neither hot
keys nor groups of copies matter. A text is scanned whole however long it is: no pattern recurses but within
a window, and no array grows by single elements beyond a block, so time goes with the text's length.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.llm.frames import fresh, texts

# The base patterns, in the order in which kinds are listed; group and least length.
BASE = {
    "assign": ("(?i)(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
               "([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("(?<![0-9a-f])[0-9a-f]{24,}+", 0, 24),
}


@dataclass(frozen=True)
class CharacterClass:
    """Runs of `characters`, scanned in windows of `window` against `bits` of entropy."""

    kind: str
    characters: str
    alphabet: str
    window: int
    bits: float
    fold: bool = False

    @property
    def pattern(self) -> str:
        return f"(?<![{self.characters}])[{self.characters}]{{{self.window},}}+"


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
CLASSES = (
    CharacterClass("hex_entropy", "0-9a-fA-F", _DIGITS + "abcdef", 20, 3.0, True),
    CharacterClass("base64_entropy", "A-Za-z0-9+/_=-", _LETTERS + _LETTERS.upper() + _DIGITS + "+/_=-",
                   20, 3.7),
)

_WORD = "([A-Za-z]?[a-z]+|[A-Z]+|[0-9]+)"
#: A window of words, slugs, paths or plain numbers is passed over. It is as short as the window.
PLAIN = f"^[+/_=-]*{_WORD}([+/_=-]+{_WORD})*[+/_=-]*$"
#: Windows that touch one of these are passed over: patterns and the length of all that they match.
MASKED = {
    "[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}": 36,
    "0123456789": 10, "1234567890": 10, "(?i)abcdefgh": 8, "(?i)placeholder": 11, "(?i)example": 7,
    "(?i)x{6}": 6, "([^ ])\\1{7}": 8,
}

_SPANS = "array<struct<start:bigint,rank:int,kind:string,`end`:bigint>>"
_RUNS = "array<struct<start:bigint,hit:string>>"
#: Elements that a growing array holds at most, and characters of a run that are scanned at a time.
_BLOCK, _CHUNK = 256, 4096


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _blocks(array: str) -> str:
    """SQL for an array in blocks, so that none of its parts grows with the whole."""
    return (f"transform(sequence(0, (greatest(size({array}), 1) - 1) div {_BLOCK}), "
            f"_k -> slice({array}, _k * {_BLOCK} + 1, {_BLOCK}))")


def _scan(array: str, carry: str, emit: str, kind: str) -> str:
    """SQL that goes over an array once: `carry` makes the next number out of `at` and the element `x`,
    and `emit` an array of what comes out, whose type is `kind`. Block by block: first the number at the start of
    each block, then what each gives."""
    numbers = (f"aggregate(bs, named_struct('at', 0L, 'out', cast(array() AS array<bigint>)), (s, b) -> "
               f"named_struct('at', aggregate(b, s.at, (at, x) -> {carry.format(at='at')}), "
               "'out', array_append(s.out, s.at)), s -> s.out)")
    each = (f"aggregate(b, named_struct('at', q[k], 'out', cast(array() AS {kind})), (s, x) -> "
            f"named_struct('at', {carry.format(at='s.at')}, 'out', concat(s.out, {emit.format(at='s.at')})), "
            "s -> s.out)")
    return _let(array, "z", _let(_blocks("z"), "bs", _let(
        numbers, "q", f"flatten(transform(bs, (b, k) -> {each}))")))


def _located(text: str, pattern: str, group: int, least: int, made: str, kind: str) -> str:
    """SQL for an array of all matches of `pattern` whose `group` has `least` characters. `made` is an
    element by `{start}` and `{hit}`: what lies between matches tells where they are."""
    p = _sql(pattern)
    found = (f"arrays_zip(split({text}, {p}, -1), regexp_extract_all({text}, {p}, 0)"
             + (f", regexp_extract_all({text}, {p}, {group})" if group else "") + ")")
    element = made.format(start="({at} + length(x.`0`))", hit="x.`1`")
    fits = f"length({'x.`2`' if group else 'x.`1`'}) >= {least}"
    scan = _scan(found, "{at} + length(x.`0`) + coalesce(length(x.`1`), 0)",
                 f"CASE WHEN {fits} THEN array({element}) ELSE cast(array() AS {kind}) END", kind)
    return f"CASE WHEN rlike({text}, {p}) THEN {scan} ELSE cast(array() AS {kind}) END"


_RUN = "named_struct('start', {start}, 'hit', {hit})"


def _span(rank: int, kind: str) -> str:
    return (f"named_struct('start', {{start}}, 'rank', {rank}, 'kind', '{kind}', "
            "'end', {start} + length({hit}))")


def _dense(runs: str, c: CharacterClass, rank: int, masked: dict[str, int], plain: str) -> str:
    """SQL for the spans of dense windows in an array of runs. A long run is scanned in chunks that overlap
    by a window less one character, so each window is in one of them."""
    w, size = c.window, len(c.alphabet) + 1
    hidden = "r.hit"
    for pattern, length in masked.items():
        hidden = f"regexp_replace({hidden}, {_sql(pattern)}, '{' ' * length}')"
    chunks = _let(hidden, "m", f"transform(sequence(0, greatest(length(m) - {w}, 0) div {_CHUNK}), "
                  f"k -> named_struct('start', r.start + k * {_CHUNK}, "
                  f"'hit', substr(m, k * {_CHUNK} + 1, {_CHUNK + w - 1})))")
    text = "lower(r.hit)" if c.fold else "r.hit"
    # The blank of what is masked is the last character of the alphabet.
    codes = f"transform(split({text}, ''), ch -> instr({_sql(c.alphabet + ' ')}, ch))"
    steps = f"arrays_zip({codes}, slice(concat(array_repeat(0, {w}), {codes}), 1, length(r.hit)))"
    weight = "(CASE WHEN {0} > 1 THEN {0} * log2({0}) ELSE 0D END)"
    # Entering and leaving characters change one count each; `sum` is the sum of n * log2(n).
    now = "element_at(s.n, x.`0`)"
    entered = f"transform(s.n, (n, j) -> n + CASE WHEN j + 1 = x.`0` THEN 1 ELSE 0 END)"
    left = "element_at(t.n, x.`1`)"
    state = ("aggregate(" + steps + ", named_struct('i', 0L, "
             f"'n', array_repeat(0, {size}), 'sum', 0D, 'from', -1L, 'to', -1L, "
             f"'out', cast(array() AS {_SPANS})), (s, x) -> ")
    enter = (f"named_struct('n', {entered}, 'sum', s.sum + {weight.format(f'({now} + 1)')} - "
             f"{weight.format(now)})")
    leave = (f"CASE WHEN x.`1` = 0 THEN t ELSE named_struct('n', transform(t.n, (n, j) -> n - "
             f"CASE WHEN j + 1 = x.`1` THEN 1 ELSE 0 END), 'sum', t.sum + "
             f"{weight.format(f'({left} - 1)')} - {weight.format(left)}) END")
    span = (f"named_struct('start', r.start + s.from, 'rank', {rank}, 'kind', '{c.kind}', "
            "'end', r.start + s.to)")
    closed = f"CASE WHEN s.from >= 0 THEN concat(s.out, array({span})) ELSE s.out END"
    first = f"(s.i + 1 - {w})"
    hot = (f"s.i + 1 >= {w} AND log2({w}D) - u.sum / {w}D >= {c.bits - 1e-9}D "
           f"AND element_at(u.n, {size}) = 0 "
           f"AND NOT rlike(substr(r.hit, cast({first} + 1 AS int), {w}), {_sql(plain)})")
    step = _let(enter, "t", leave)
    move = _let(step, "u", _let(f"({hot})", "h", (
        "named_struct('i', s.i + 1, 'n', u.n, 'sum', u.sum, "
        f"'from', CASE WHEN NOT h THEN s.from WHEN s.from >= 0 AND {first} <= s.to "
        f"THEN s.from ELSE {first} END, "
        "'to', CASE WHEN h THEN s.i + 1 ELSE s.to END, "
        f"'out', CASE WHEN h AND s.from >= 0 AND {first} > s.to THEN {closed} ELSE s.out END)")))
    found = (f"flatten(transform(flatten(transform({runs}, r -> {chunks})), "
             f"r -> {state}{move}, s -> {closed})))")
    # What touches across chunks is one span.
    merged = ("transform(arrays_zip(filter(d, (x, i) -> i = 0 OR x.start > get(d, i - 1).`end`), "
              "filter(d, (x, i) -> i = size(d) - 1 OR get(d, i + 1).start > x.`end`)), e -> "
              f"named_struct('start', e.`0`.start, 'rank', {rank}, 'kind', '{c.kind}', "
              "'end', e.`1`.`end`))")
    return _let(found, "d", merged)


def with_spans(df: DataFrame, text_col: str, name: str,
               classes: tuple[CharacterClass, ...] = CLASSES,
               masked: dict[str, int] = MASKED, plain: str = PLAIN) -> DataFrame:
    """`df` with an array of base spans in `name`.base and of all spans in `name`.all, by start and
    kind. A dense span inside a base span adds nothing and is left out."""
    text, base, runs, every = (fresh(df, x) for x in ("_text", "_base", "_runs", "_every"))
    df = df.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    found = ", ".join(_located(f"`{text}`", p, g, n, _span(rank, kind), _SPANS)
                      for rank, (kind, (p, g, n)) in enumerate(BASE.items()))
    df = df.withColumn(base, F.expr(f"array_sort(concat({found}))"))
    df = df.withColumn(runs, F.struct(*[
        F.expr(_located(f"`{text}`", c.pattern, 0, c.window, _RUN, _RUNS)).alias(c.kind)
        for c in classes]))
    spans = ", ".join([f"`{base}`", *(_dense(f"`{runs}`.{c.kind}", c, len(BASE) + i, masked, plain)
                                      for i, c in enumerate(classes))])
    df = df.withColumn(every, F.expr(f"array_sort(concat({spans}))"))
    # By start, base spans first: a span is inside a base span if one so far ends no earlier.
    known = f"x.rank < {len(BASE)}"
    kept = _scan(f"`{every}`", f"CASE WHEN {known} THEN greatest({{at}}, x.`end`) ELSE {{at}} END",
                 f"CASE WHEN {known} OR x.`end` > {{at}} THEN array(x) ELSE cast(array() AS {_SPANS}) END",
                 _SPANS)
    none = f"size(`{every}`) = 0 OR size(`{every}`) = size(`{base}`)"
    result = F.struct(F.col(base).alias("base"),
                      F.expr(f"CASE WHEN {none} THEN `{every}` ELSE {kept} END").alias("all"))
    return df.withColumn(name, result).drop(text, base, runs, every)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 classes: tuple[CharacterClass, ...] = CLASSES,
                 masked: dict[str, int] = MASKED, plain: str = PLAIN) -> DataFrame:
    """`doc_id, base, all`: the spans of every row, as arrays of `start, rank, kind, end`."""
    return (with_spans(texts(df, id_col, text_col), "text", "_spans", classes, masked, plain)
            .select("doc_id", "_spans.base", "_spans.all"))


def redacted(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]",
             found_col: str | None = None) -> DataFrame:
    """`df` with every span in `text_col` replaced by `mark`, spans that overlap by one. Rows without one are
    as they were, null texts included. With `found_col`, a column that says whether there was any."""
    name, keep = fresh(df, "_spans"), fresh(df, "_keep")
    found = with_spans(df, text_col, name)
    text = f"`{text_col}`"
    part, kind = "named_struct('from', {at}, 'to', x.start)", "array<struct<`from`:bigint,to:bigint>>"
    kept = _scan(f"`{name}`.all", "greatest({at}, x.`end`)",
                 f"CASE WHEN x.start >= {{at}} THEN array({part}) ELSE cast(array() AS {kind}) END", kind)
    last = f"named_struct('from', array_max(transform(`{name}`.all, x -> x.`end`)), 'to', cast(length({text}) AS bigint))"
    found = found.withColumn(keep, F.expr(
        f"CASE WHEN size(`{name}`.all) > 0 THEN array_append({kept}, {last}) ELSE cast(array() AS {kind}) END"))
    # The parts of a block are cut out of the block's own text, which is short.
    own = f"substr({text}, cast(b[0].`from` + 1 AS int), cast(element_at(b, -1).to - b[0].`from` AS int))"
    cut = _let(own, "t", "transform(b, p -> substr(t, cast(p.`from` - b[0].`from` + 1 AS int), "
               "cast(p.to - p.`from` AS int)))")
    pieces = f"flatten(transform({_blocks(f'`{keep}`')}, b -> {cut}))"
    whole = F.when(F.size(keep) > 0, F.expr(f"array_join({pieces}, {_sql(mark)})")).otherwise(F.col(text_col))
    columns = [whole.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    return found.select(*columns, *([(F.size(keep) > 0).alias(found_col)] if found_col else []))
