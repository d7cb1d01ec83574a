"""CPE 2.3 strings as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from devident.fixed_values import CPE_FIELDS, CPE_TOKENS
from devident.functions.text import let, strip

# prefix, known part, named vendor and product, eight more tokens
_VALID = r"\Acpe:2\.3:[hoa]:(?!\*:)[^:]+:(?!\*:)[^:]+(?::[^:]*){8}\z"
# an empty field of a colon list
_EMPTY_FIELD = r"(?:\A|(?<=:))(?=:|\z)"


def _tokens(c: Column) -> Column:
    return F.split(c, ":", -1)


def _colons(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(":"), F.lit("")))


def _well_formed(tokens: Column) -> Column:
    return (
        (F.size(tokens) == CPE_TOKENS)
        & (F.get(tokens, F.lit(0)) == "cpe")
        & (F.get(tokens, F.lit(1)) == "2.3")
    )


def cpe_parse(c: Column) -> Column:
    """The eleven named fields as a struct; NULL unless there are 13 tokens and the 2.3 prefix."""
    tokens = _tokens(c)
    fields = [F.get(tokens, F.lit(i + 2)).alias(name) for i, name in enumerate(CPE_FIELDS)]
    return F.when(_well_formed(tokens), F.struct(*fields))


def with_cpe_fields(df: DataFrame, cpe: str, fields: dict[str, str]) -> DataFrame:
    """Add chosen CPE fields (field name to column name); the text is split once per row.

    All are NULL for a malformed identifier; a field of a well-formed one is never NULL. The fields
    come out of a generator of one row: a filter on them (joins infer such filters) is then not
    rewritten into further splits.
    """
    tokens = F.col("_tokens")
    picked = F.struct(
        *[F.get(tokens, F.lit(CPE_FIELDS.index(field) + 2)).alias(column) for field, column in fields.items()]
    )
    one = F.when(_well_formed(tokens), F.array(picked))
    return df.withColumn("_tokens", _tokens(F.col(cpe))).select(*df.columns, F.inline_outer(one))


def cpe_is_valid(c: Column) -> Column:
    """Structurally valid and naming a vendor and a product; false for NULL."""
    return F.coalesce(c.rlike(_VALID), F.lit(False))


def cpe_normalize(c: Column) -> Column:
    """Long 2.3 form of a short or shortened identifier; NULL when it is neither.

    Short forms with more than eleven fields pass through over-long.
    """
    return let(strip(c), _normalized)


def _normalized(text: Column) -> Column:
    def long_form(tokens: Column) -> Column:
        return F.when(tokens == CPE_TOKENS, text).when(
            tokens.between(5, CPE_TOKENS - 1), F.concat(text, F.repeat(F.lit(":*"), CPE_TOKENS - tokens))
        )

    def short_form(body: Column) -> Column:
        # few identifiers have an empty field
        gaps = body.startswith(":") | body.endswith(":") | body.contains("::")
        named = F.when(gaps, F.regexp_replace(body, _EMPTY_FIELD, "*")).otherwise(body)

        def padded(fields: Column) -> Column:
            padding = F.greatest(F.lit(len(CPE_FIELDS)) - fields, F.lit(0))
            return F.when(fields >= 3, F.concat(F.lit("cpe:2.3:"), named, F.repeat(F.lit(":*"), padding)))

        return let(_colons(body) + 1, padded)

    return F.when(text.startswith("cpe:2.3:"), let(_colons(text) + 1, long_form)).when(
        text.startswith("cpe:/"), let(F.substr(text, F.lit(len("cpe:/") + 1)), short_form)
    )
