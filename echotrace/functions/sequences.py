"""Column functions on token sequences: built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """White-space tokens; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\\s+"), lambda x: x != "")


def token_window(seq: Column, offset: Column | int, prefix: Column | int, suffix: Column | int | None = None) -> Column:
    """seq[offset : offset + prefix + suffix]; the suffix is as long as the prefix unless given."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    p = as_column(prefix)
    return F.slice(seq, as_column(offset) + 1, p + (p if suffix is None else as_column(suffix)))


def prefix_of(window: Column, n: Column | int) -> Column:
    return F.slice(window, F.lit(1), n if isinstance(n, Column) else F.lit(n))


def suffix_of(window: Column, n: Column | int) -> Column:
    n = n if isinstance(n, Column) else F.lit(n)
    return F.slice(window, n + 1, F.greatest(F.size(window) - n, F.lit(0)))


def with_bos(seq: Column, bos) -> Column:
    return F.array_prepend(seq, F.lit(bos))


def ngrams(seq: Column, n: int) -> Column:
    """All windows of n elements, stride 1."""
    last = F.size(seq) - n + 1
    return F.when(last >= 1, F.transform(F.sequence(F.lit(1), last), lambda i: F.slice(seq, i, n))).otherwise(F.slice(F.array(seq), 1, 0))


def type_token_ratio(seq: Column) -> Column:
    """Distinct over all; null for an empty sequence."""
    return F.when(F.size(seq) > 0, F.size(F.array_distinct(seq)) / F.size(seq))


def positions(seq: Column, value) -> Column:
    """0-based positions of value."""
    value = value if isinstance(value, Column) else F.lit(value)
    marked = F.transform(seq, lambda x, i: F.when(x == value, i))
    return F.filter(marked, lambda i: i.isNotNull())


def context(seq: Column, at: Column, before: int = 5, after: int = 5) -> Column:
    """The elements from `before` places before position `at` to `after` places behind it."""
    start = F.greatest(at - before, F.lit(0))
    return F.slice(seq, start + 1, at + after + 1 - start)


def non_padding(seq: Column, pad=0) -> Column:
    """How many elements aren't the padding, id 0 for ids."""
    return F.size(F.filter(seq, lambda x: x != pad))


def token_nll(logits: Column, token: Column) -> Column:
    """Cross-entropy of a token (0-based) under logits: log(sum(exp(x - max))) + max - x[token]."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top.cast("double")))
    return F.log(total) + top.cast("double") - F.get(logits, token).cast("double")


def character_range(text: Column, start: int, end: int) -> Column:
    return F.substring(text, start + 1, end - start)


def escape_markup(text: Column) -> Column:
    """< and > only, as the report needs it."""
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def visible_white_space(text: Column) -> Column:
    for sign, shown in (("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(sign), F.lit(shown))
    return text


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def highlighted(seq: Column, at: Column, opening: str = "<mark>", closing: str = "</mark>") -> Column:
    """The tokens as one string, those at the given positions between marks."""
    shown = F.transform(
        seq,
        lambda x,
        i: F.when(F.array_contains(at, i), F.concat(F.lit(opening), escape_markup(x.cast("string")), F.lit(closing))).otherwise(
            escape_markup(x.cast("string"))
        ),
    )
    return F.array_join(shown, " ")


def chat_messages(texts: Column, role: str = "user") -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(role).alias("role"), t.alias("content")))


def paraphrase_prompt(text: Column) -> Column:
    return F.concat(
        F.lit("Rewrite the following text in other words and keep its meaning.\n\nText:\n"), text, F.lit("\n\nRewritten text:\n")
    )


def chat_request(texts: Column, schema: str | None = None, role: str = "user") -> Column:
    """The JSON body of one chat request with all texts as its messages; schema: a JSON schema that answers have to keep."""
    fields = [chat_messages(texts, role).alias("messages")]
    if schema is not None:
        fields.append(F.lit(schema).alias("schema"))
    return F.to_json(F.struct(*fields))


def int_set(text: Column) -> Column:
    """The distinct numbers of a comma-separated list, ascending; what isn't a number goes."""
    return F.array_sort(
        F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()))
    )


def capitalised(text: Column) -> Column:
    """The first letter upper case, the others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def timestamp_text(at: Column) -> Column:
    """A time as it stands in file names."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def included(column: Column, names: list | None) -> Column:
    """True for the listed values; no list stands for all."""
    return F.lit(True) if names is None else column.isin(names)


def rouge_l(lcs: Column, n_reference: Column, n_candidate: Column) -> Column:
    """F1 of precision lcs / n_candidate and recall lcs / n_reference; 0 where either is empty."""
    both = n_reference + n_candidate
    return F.when((n_reference > 0) & (n_candidate > 0) & (lcs > 0), 2 * lcs / both).otherwise(F.lit(0.0))


#: Comparison operators by their sign.
COMPARISONS: dict[str, Callable[[Column, object], Column]] = {
    ">=": lambda a, b: a >= b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}
