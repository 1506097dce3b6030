"""Column helpers for text. All stay inside the JVM; none of them shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from brightloom.functions import fixed


def strip(text: Column) -> Column:
    """Trim every Unicode white-space character, not only blanks."""
    return F.btrim(text, F.lit(fixed.SPACE_CHARS))


def squeeze(text: Column) -> Column:
    """Collapse each white-space run to one blank and trim."""
    return strip(F.regexp_replace(text, fixed.SPACE_CLASS + "+", " "))


def lines(text: Column) -> Column:
    return F.split(text, fixed.LINE_BREAK)


def tokens(text: Column, pattern: str = fixed.WORD) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def search_terms(text: Column, stop_words: Iterable[str] = fixed.SEARCH_STOP_WORDS) -> Column:
    """Tokens without stop words, one trailing ``s`` removed from words over three letters."""
    stops = list(stop_words)
    kept = F.filter(tokens(text), lambda t: ~t.isin(stops))
    return F.transform(
        kept,
        lambda t: F.when((F.length(t) > 3) & t.endswith("s"), F.substring(t, F.lit(1), F.length(t) - 1)).otherwise(t),
    )


def distinct_terms(text: Column, stop_words: Iterable[str]) -> Column:
    stops = list(stop_words)
    return F.array_distinct(F.filter(tokens(text), lambda t: ~t.isin(stops)))


def content_keywords(text: Column) -> Column:
    """Distinct content words in first-seen order; short words survive only when numeric."""
    bare = F.transform(tokens(text, fixed.DOTTED_WORD), lambda t: F.btrim(t, F.lit(".")))
    kept = F.filter(
        bare,
        lambda t: (t != "")
        & ~t.isin(fixed.JUDGE_STOP_WORDS)
        & ((F.length(t) >= 3) | t.rlike("^[0-9]+$")),
    )
    return F.array_distinct(kept)


def coverage_keywords(text: Column) -> Column:
    return F.array_distinct(
        F.filter(
            tokens(text, fixed.CONTRACTION_WORD),
            lambda t: (F.length(t) >= 3) & ~t.isin(fixed.COVERAGE_STOP_WORDS),
        )
    )


def sentences(text: Column, enders: str = ".!?") -> Column:
    """Non-blank sentences, trimmed; a boundary is white space after an end mark."""
    parts = F.split(text, f"(?<=[{enders}]){fixed.SPACE_CLASS}+")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def snippet(text: Column, n: int = 2) -> Column:
    """The first ``n`` sentences, where only a full stop ends a sentence."""
    parts = F.split(strip(text), rf"(?<=\.){fixed.SPACE_CLASS}+")
    return F.array_join(F.slice(parts, 1, n), " ")


def fixed_chunks(text: Column, size: int, overlap: int) -> Column:
    """Character windows of ``size`` sharing ``overlap`` characters; blank windows dropped."""
    if size <= 0:
        raise ValueError(f"a chunk needs at least one character, not {size}")
    if not 0 <= overlap < size:
        raise ValueError(f"chunks of {size} cannot overlap by {overlap}")
    step = size - overlap
    last = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    cut = F.transform(
        F.sequence(F.lit(0), last), lambda i: strip(F.substring(text, i * step + 1, F.lit(size)))
    )
    return F.filter(cut, lambda piece: piece != "")


def sentence_chunks(text: Column, size: int) -> Column:
    """Whole sentences packed greedily up to ``size`` characters; a longer sentence stays whole."""
    if size <= 0:
        raise ValueError(f"a chunk needs at least one character, not {size}")

    def pack(acc: Column, sentence: Column) -> Column:
        full = (acc["open"] != "") & (F.length(acc["open"]) + 1 + F.length(sentence) > size)
        return F.struct(
            F.when(full, F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]).alias("done"),
            F.when(full | (acc["open"] == ""), sentence)
            .otherwise(F.concat(acc["open"], F.lit(" "), sentence))
            .alias("open"),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    packed = F.aggregate(
        sentences(text),
        start,
        pack,
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])),
    )
    return packed


def scrub(text: Column) -> Column:
    """Replace e-mail addresses, then phone numbers, by their marks (Unicode word classes)."""
    no_mail = F.regexp_replace(text, "(?U)" + fixed.EMAIL, fixed.EMAIL_MARK)
    return F.regexp_replace(no_mail, "(?U)" + fixed.PHONE, fixed.PHONE_MARK)


def dedupe_key(text: Column) -> Column:
    """Case- and white-space-insensitive key, hashed to a fixed width."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), fixed.SPACE_CLASS + "+", " "), 256)


def list_items(text: Column) -> Column:
    """Numbered or bulleted lines; without any, the bare lines that end in ``?``."""
    rows = F.filter(F.transform(lines(text), strip), lambda s: s != "")
    marked = F.filter(rows, lambda s: s.rlike(fixed.LIST_MARK))
    items = F.filter(
        F.transform(marked, lambda s: strip(F.regexp_replace(s, fixed.LIST_MARK, ""))), lambda s: s != ""
    )
    bare = F.filter(rows, lambda s: ~s.rlike(fixed.LIST_MARK) & s.endswith("?"))
    return F.when(F.size(items) > 0, F.array_distinct(items)).otherwise(F.array_distinct(bare))


def score_field(text: Column, top: float = 10.0) -> Column:
    """Number after ``score:`` clamped to 0..top; null when absent."""
    raw = F.regexp_extract(text, fixed.SCORE_FIELD, 1)
    value = F.when(raw != "", raw.cast("double"))
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0.0)), F.lit(top)))


def verdict_score(text: Column) -> Column:
    """Judge score clamped to 0..1; 0 when the reply has none."""
    raw = F.regexp_extract(text, fixed.VERDICT_SCORE, 1)
    value = F.when(raw != "", raw.cast("double")).otherwise(F.lit(0.0))
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def verdict_rationale(text: Column) -> Column:
    found = strip(F.regexp_extract(text, fixed.VERDICT_RATIONALE, 1))
    return F.when(text.rlike(fixed.VERDICT_RATIONALE), found).otherwise(F.substring(strip(text), 1, 200))


def feedback_items(text: Column) -> Column:
    """Bullets after the first line that starts with FEEDBACK."""
    rows = F.transform(lines(text), strip)
    heads = F.transform(rows, lambda s: F.upper(s).startswith("FEEDBACK"))
    first = F.array_position(heads, True)
    found = F.filter(
        rows,
        lambda s, i: (first > 0) & (i + 1 > first) & (s.startswith("-") | s.startswith("*")),
    )
    return F.transform(found, lambda s: strip(F.ltrim(s, F.lit("-* "))))


def sections(text: Column, heading: str = r"(?m)^(?=#{1,6}[ \t]+\S)") -> Column:
    """Heading sections of one markdown text as ``array<struct<section, body>>``.

    The split happens in front of each heading line, so a piece either starts
    with its own heading or is the text before the first one.
    """
    head = r"^#{1,6}[ \t]+(\S.*?)\s*$"

    def shape(piece: Column) -> Column:
        first = F.regexp_extract(piece, r"^([^\n\r]*)", 1)
        titled = first.rlike(head)
        title = F.when(titled, F.regexp_extract(first, head, 1))
        body = F.when(titled, F.substring(piece, F.length(first) + 1, F.length(piece))).otherwise(piece)
        return F.struct(title.alias("section"), strip(body).alias("body"))

    shaped = F.transform(F.split(text, heading), shape)
    return F.filter(shaped, lambda s: s["body"] != "")


def fill(template: str, **parts: Column) -> Column:
    """Concatenate a literal template with columns for its ``{name}`` slots."""
    import string

    pieces: list[Column] = []
    for literal, name, _, _ in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if name:
            pieces.append(parts[name])
    return F.concat(*pieces)


def first_sentence(text: Column) -> Column:
    """Opening sentence (up to a full stop) with exactly one trailing full stop."""
    head = F.element_at(F.split(strip(text), rf"(?<=\.){fixed.SPACE_CLASS}+", 2), 1)
    return F.concat(F.rtrim(head, F.lit(".")), F.lit("."))


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags dropped, white space squeezed."""
    bare = F.regexp_replace(html, r"(?s)<script.*?</script>|<style.*?</style>|<[^>]*>", " ")
    return squeeze(bare)


def counted(tokens: Column) -> Column:
    """``array<struct<term, tf>>`` of a token array, in term order: counted on the row, in one pass over the sorted tokens."""
    def runs(ordered: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(ordered)), lambda i: (i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2)))
        return F.when(F.size(ordered) > 0, F.transform(F.array(starts), lambda s: F.transform(s, lambda at, i: F.struct(
            F.get(ordered, at - 1).alias("term"), (F.coalesce(F.get(s, i + 1), F.size(ordered) + 1) - at).cast("long").alias("tf")
        )))[0])

    # A one-element array names the sorted tokens, so they are sorted once.
    return F.coalesce(F.transform(F.array(F.array_sort(tokens)), runs)[0], F.array().cast("array<struct<term:string,tf:bigint>>"))
