"""RDF terms as Spark columns. A null column means "no term"; every function passes nulls on.

All rules are built-in expressions, so term building stays in generated code.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that count as null.
NULL_TOKENS = ("nan", "N/A", "None")
_BLANK = r"(?U)^[\s|]*$"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"
_PLACEHOLDER = re.compile(r"(?<!\\)\{(.+?)(?<!\\)\}")
_DECIMAL = r"^-?[0-9]+\.[0-9]+$"
#: Decimals of up to 15 digits that no exponent is needed for: zeros at the ends are all that goes.
_PLAIN = r"^-?(?:0*[1-9][0-9]*\.[0-9]+|0+\.(?:0{0,3}[1-9][0-9]*|0+))$"


def present(value: Column) -> Column:
    """The value, or null if it is one of the null tokens, or only white space and pipes."""
    return F.when(~value.isin(*NULL_TOKENS) & ~value.rlike(_BLANK), value)


def strip(value: Column) -> Column:
    """Without white space at either end, of any script."""
    return F.regexp_replace(value, _EDGES, "")


def encode(value: Column) -> Column:
    """Percent-encoding of the UTF-8 bytes, but for unreserved characters and ``~ # / :``."""
    out = F.url_encode(value)
    for old, new in (("+", "%20"), ("*", "%2A"), ("%7E", "~"), ("%2F", "/"), ("%23", "#"), ("%3A", ":")):
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _positional(text: Column) -> Column:
    """Digits of a number's text (with or without an exponent) as a repr shows them: an exponent below 1e-4 and from 1e16 on."""

    def split(t: Column) -> Column:
        power = F.coalesce(F.nullif(F.regexp_extract(t, r"[eE]\+?(-?[0-9]+)$", 1), F.lit("")).cast("int"), F.lit(0))
        return F.struct(F.startswith(t, F.lit("-")).alias("minus"), F.regexp_extract(t, r"^-?([0-9]+)", 1).alias("whole"), F.regexp_extract(t, r"\.([0-9]+)", 1).alias("fraction"), power.alias("power"))

    def place(x: Column) -> Column:
        led = F.ltrim(F.concat(x["whole"], x["fraction"]), F.lit("0"))
        return F.struct(x["minus"].alias("minus"), F.rtrim(led, F.lit("0")).alias("digits"), (x["power"] - F.length(x["fraction"]) + F.length(led)).alias("point"))

    def show(x: Column) -> Column:
        digits, at, n = x["digits"], x["point"], F.length(x["digits"])
        exponent = F.format_string("%s%se%+03d", F.substr(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), at - 1)
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -at), digits)
        padded = F.rpad(digits, F.greatest(n, at + 1), F.lit("0"))
        body = F.when(n == 0, "0.0").when((at < -3) | (at > 16), exponent).when(at <= 0, small).otherwise(F.concat(F.substr(padded, F.lit(1), at), F.lit("."), F.substr(padded, at + 1)))
        return F.concat(F.when(x["minus"], "-").otherwise(""), body)

    return _with(_with(_with(text, split), place), show)


def _shortest(number: Column, text: Column, tiny: bool) -> Column:
    """The shortest digits that read as a double again; the JVM's own text may have more than it takes. ``tiny``: for numbers without a leading bit as well."""

    def first(places: range) -> Column:
        made = F.array(*[F.format_string(f"%.{n}e", number) for n in places])
        return F.coalesce(F.get(F.filter(made, lambda t: t.cast("double") == number), F.lit(0)), text)

    # the digits, a sign, a point and what belongs to the exponent
    long = F.when(F.length(text) - F.length(F.regexp_extract(text, "E.*", 0)) > 16, first(range(14, 17))).otherwise(text)
    return F.when((F.abs(number) < 2.3e-308) & (number != 0), first(range(17))).otherwise(long) if tiny else long


def float_text(number: Column, tiny: bool = True) -> Column:
    """A double or float as the text of its shortest digits: ``0.1``, ``1e-12``, ``1e+16``, ``inf``; not a number is null."""
    text = number.cast("string")
    special = F.when(F.isnan(number), F.lit(None).cast("string")).when(F.contains(text, F.lit("Inf")), F.replace(F.lower(text), F.lit("inity"), F.lit("")))
    hard = _with(F.struct(number.cast("double").alias("n"), text.alias("t")), lambda v: _positional(_shortest(v["n"], v["t"], tiny)))
    return F.when(~text.rlike("[EIN]") & (F.length(text) <= 16), text).otherwise(special.otherwise(hard))


def normal_decimal(value: Column) -> Column:
    """``007.10`` as ``7.1``: a decimal's text as that of its double; other texts as they are."""
    bare = F.ltrim(F.rtrim(F.ltrim(value, F.lit("-")), F.lit("0")), F.lit("0"))
    shorter = F.concat(F.when(F.startswith(value, F.lit("-")), "-").otherwise(""), F.when(F.startswith(bare, F.lit(".")), "0").otherwise(""), bare, F.when(F.endswith(bare, F.lit(".")), "0").otherwise(""))
    plain = (F.length(value) <= 16) & value.rlike(_PLAIN)
    return F.when(~F.contains(value, F.lit(".")), value).when(plain, shorter).when(value.rlike(_DECIMAL), float_text(value.try_cast("double"), False)).otherwise(value)


def template_parts(template: str) -> list[tuple[str, bool]]:
    """Literal pieces and placeholders (True), in order; ``\\{`` and ``\\}`` are literal braces. A condition in brackets is cut off a name."""
    parts, at = [], 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > at:
            parts.append((template[at : m.start()].replace("\\{", "{").replace("\\}", "}"), False))
        parts.append((m[1], True))
        at = m.end()
    if at < len(template):
        parts.append((template[at:].replace("\\{", "{").replace("\\}", "}"), False))
    return parts


def placeholder_count(template: str) -> int:
    return sum(is_name for _, is_name in template_parts(template))


class Value(NamedTuple):
    """One source value in the forms that terms need; a null stays null in each."""

    key: Column  #: as it is, for joins
    text: Column  #: with decimals normalised
    stripped: Column
    encoded: Column  #: percent-encoded unless it has ``http``, then stripped
    plain: Column  #: stripped only
    reference: Column  #: stripped, with double quotes as apostrophes


#: How each form follows from the ones before; a form that is used often is computed once if it is a column of its own.
FORMS: tuple[tuple[str, Callable[[dict[str, Column]], Column]], ...] = (
    ("key", lambda v: present(v["raw"])),
    ("text", lambda v: normal_decimal(v["key"])),
    ("stripped", lambda v: strip(v["text"])),
    ("encoded", lambda v: strip(F.when(F.contains(v["text"], F.lit("http")), v["text"]).otherwise(encode(v["text"])))),
    ("plain", lambda v: strip(v["key"])),
    ("reference", lambda v: F.replace(v["plain"], F.lit('"'), F.lit("'"))),
)


def value_of(raw: Column) -> Value:
    """All forms of a text column."""
    made = {"raw": raw}
    for name, form in FORMS:
        made[name] = form(made)
    return Value(**{k: v for k, v in made.items() if k != "raw"})


def template(text: str, value: Callable[[str], Value]) -> Column:
    """The filled template; null if any placeholder is. Values are encoded where the text before them has ``http``."""
    pieces: list[Column] = []
    prefix, fixed = "", True  # the fixed text so far, and whether there is nothing else
    for part, is_name in template_parts(text):
        if not is_name:
            pieces.append(F.lit(part))
            prefix += part
            continue
        v = value(part)
        if "http" in prefix:
            pieces.append(v.encoded)
        elif fixed:
            pieces.append(v.stripped)
        else:  # an earlier value may hold it
            pieces.append(F.when(F.contains(F.concat(*pieces), F.lit("http")), v.encoded).otherwise(v.stripped))
        fixed = False
    return F.concat(*pieces) if pieces else F.lit("")


def iri(value: Column) -> Column:
    return F.concat(F.lit("<"), value, F.lit(">"))


def subject_template(value: Column, term_type: str | None, base: str, has_condition: bool = False) -> Column:
    kind = term_type or ""
    if "IRI" in kind:
        inner = value if has_condition else encode(value)
        return F.when(F.contains(value, F.lit("http")), iri(inner)).otherwise(iri(F.concat(F.lit(base), value)))
    if "BlankNode" in kind:
        if has_condition:
            return F.concat(F.lit("_:"), value)
        label = F.replace(encode(F.replace(value, F.lit("/"), F.lit("2F"))), F.lit("%"), F.lit(""))
        return F.concat(F.lit("_:"), F.replace(label, F.lit("."), F.lit("2E")))
    if "Literal" in kind:
        return F.lit(None).cast("string")
    return iri(value)


def subject_reference(text: Column, term_type: str | None, base: str) -> Column:
    if "BlankNode" in (term_type or ""):
        return F.concat(F.lit("_:"), text)
    plain = F.when(F.contains(text, F.lit("http")), iri(text)).otherwise(iri(F.concat(F.lit(base), text)))
    return F.when(~F.contains(text, F.lit(" ")), plain)


def object_constant(value: str, datatype: str | None = None, legacy: bool = True) -> str:
    if not legacy and (datatype or "/" not in value):
        for old, new in _ESCAPES:
            value = value.replace(old, new)
    if datatype:
        return f'"{value}"^^<{datatype}>'
    return f"<{value}>" if "/" in value else f'"{value}"'


def object_template(value: Column, term_type: str | None, datatype: str | None, suffix: Column | None, legacy: bool = True) -> Column:
    kind = term_type or ""
    if "BlankNode" in kind:
        label = encode(F.concat(F.lit("_:"), value))
        return F.replace(F.replace(label, F.lit("/"), F.lit("2F")), F.lit("."), F.lit("2E"))
    if "Literal" in kind:
        text = F.concat(F.lit('"'), value if legacy else valid_escape(value), F.lit('"'))
        if datatype:
            return F.concat(text, F.lit(f"^^<{datatype}>"))
        return F.concat(text, suffix) if suffix is not None else text
    return iri(value)


def object_reference(text: Column, term_type: str | None, datatype: str | None, suffix: Column | None, legacy: bool = True) -> Column:
    kind = term_type or ""
    if not datatype and suffix is None:
        if "IRI" in kind:
            return F.when(~F.contains(text, F.lit(" ")), iri(encode(text)))
        if "BlankNode" in kind:
            return F.concat(F.lit("_:"), text)
    quoted = F.concat(F.lit('"'), escape(text) if legacy else valid_escape(text), F.lit('"'))
    if datatype:
        return F.concat(quoted, F.lit(f"^^<{datatype}>"))
    return F.concat(quoted, suffix) if suffix is not None else quoted


def escape(text: Column) -> Column:
    """Backslashes doubled, then apostrophes behind two of them, then line feeds as two characters."""
    for old, new in (("\\", "\\\\"), ("'", "\\\\'"), ("\n", "\\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


#: The escapes of a literal in N-Triples.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"))


def valid_escape(text: Column) -> Column:
    """What N-Triples asks for, and no more."""
    for old, new in _ESCAPES:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def language_suffix(language: str) -> str:
    """The tag for a declared language; unusual ones have none. The names and tags."""
    for names, tag in ((("spanish", "es"), "@es"), (("english", "en"), "@en")):
        if any(n in language for n in names):
            return tag
    return f"@{language}" if len(language) == 2 else ""


def language_column(value: Column) -> Column:
    """The tag that a column names, or nothing where it is null."""
    return F.coalesce(F.concat(F.lit("@"), value), F.lit(""))


def quoted(s: Column, p: Column, o: Column) -> Column:
    return F.concat(F.lit("<< "), s, F.lit(" "), p, F.lit(" "), o, F.lit(" >>"))


def base36(number: Column) -> Column:
    return F.conv(number.cast("string"), 10, 36)


def composite_key(*columns: Column) -> Column:
    """Key text of several columns as it was once formed: joined by underscores, nulls skipped."""
    return F.concat_ws("_", *columns)


def equal_fields(left: dict[str, Column], right: dict[str, Column]) -> Column:
    """How many fields of the same name are equal."""
    same = [F.coalesce((left[k] == right[k]).cast("int"), F.lit(0)) for k in left if k in right]
    return sum(same[1:], same[0]) if same else F.lit(0)


def key_name(columns: list[str]) -> str:
    """Name of a composite key: its columns joined by underscores, but for one that the name so far contains."""
    name = ""
    for column in columns:
        if column not in name:
            name += f"{column}_"
    return name[:-1]


def has_columns(wanted: list[str], held: list[str]) -> bool:
    """Whether all wanted columns are there."""
    return set(wanted) <= set(held)


def row_map(columns: list[str]) -> Column:
    """A row as a map from column names to texts."""
    return F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"`{c}`").cast("string"))])


def file_stem(path: Column) -> Column:
    """The last part of a path up to its first dot."""
    return F.regexp_extract(path, r"([^/.]*)[^/]*$", 1)


def brace_count(template: str) -> int:
    """Opening braces, escaped ones too."""
    return template.count("{")


def clean_suffix(text: Column) -> Column:
    """Letters, digits and ``_-()`` stay, slashes and backslashes become hyphens, the rest goes; a text with ``http`` stays as it is."""
    return F.when(F.contains(text, F.lit("http")), text).otherwise(F.regexp_replace(F.translate(text, "/\\", "--"), r"[^\p{L}\p{N}_()\-]", ""))
