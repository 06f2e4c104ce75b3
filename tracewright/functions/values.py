"""Column functions over names, times and attribute values.

Schemas: a name is struct(uri, prefix, local); names are equal when their uris are.
A time is struct(lex, micros, aware): naive and aware times are never equal. A value is
struct(kind, lex, datatype, lang, cmp) with kind str, bool, int, float, datetime, iri,
qname or literal; two values of one attribute are the same when kind and cmp are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .catalog import BASE_KIND, PROV, XSD

NAME = "struct<uri:string,prefix:string,local:string>"
TIME = "struct<lex:string,micros:bigint,aware:boolean>"
VALUE = "struct<kind:string,lex:string,datatype:string,lang:string,cmp:string>"
ATTRS = f"array<struct<name:{NAME},value:{VALUE}>>"


def text(x: Column | str) -> Column:
    """A column of strings: a Column cast to string, or a str as a literal."""
    return x.cast("string") if isinstance(x, Column) else F.lit(x)


def let(x: Column, f) -> Column:
    """f of x, with x computed once however often f uses it."""
    return F.get(F.transform(F.array(x), f), 0)


# names


def name(prefix: str, namespace: str, local: Column | str) -> Column:
    """The name of `local` in a namespace; null where local is null."""
    local = text(local)
    made = F.struct(F.concat(F.lit(namespace), local).alias("uri"), F.lit(prefix).alias("prefix"), local.alias("local"))
    return F.when(local.isNotNull(), made)


def prov(local: str) -> Column:
    return name("prov", PROV, local)


def no_name() -> Column:
    return F.lit(None).cast(NAME)


def name_text(n: Column) -> Column:
    """prefix:local, or local alone without a prefix."""
    return F.when(F.coalesce(n["prefix"], F.lit("")) == "", n["local"]).otherwise(F.concat(n["prefix"], F.lit(":"), n["local"]))


def escape_local(local: Column) -> Column:
    """A backslash before each of = ' ( ) , : ; [ ]."""
    return F.regexp_replace(local, r"([='(),:;\[\]])", r"\\$1")


def provn_name(n: Column) -> Column:
    local = escape_local(n["local"])
    return F.when(F.coalesce(n["prefix"], F.lit("")) == "", local).otherwise(F.concat(n["prefix"], F.lit(":"), local))


def in_namespace(uri: Column, namespace: Column) -> Column:
    return F.startswith(uri, namespace)


def local_in(uri: Column, namespace: Column) -> Column:
    """What follows the namespace in the uri, or null if the uri is not in it."""
    return F.when(F.startswith(uri, namespace), F.substr(uri, F.length(namespace) + 1))


def base_kind(kind: Column) -> Column:
    """The kind that a subtype belongs to; null for what is no kind."""
    pairs = [F.lit(x) for pair in BASE_KIND.items() for x in pair]
    return F.create_map(*pairs)[kind]


# numbers, booleans, times


def canonical_decimal(lex: Column) -> Column:
    """Equal for decimal numbers of equal value, at any length: sign, digits without outer
    zeros, exponent. Null for what is no finite decimal number."""
    number = r"^\s*([+-]?)([0-9]*)(?:\.([0-9]*))?(?:[eE]([+-]?[0-9]+))?\s*$"
    part = [F.regexp_extract(lex, number, i) for i in range(5)]
    parts = F.struct(part[1].alias("sign"), F.concat(part[2], part[3]).alias("digits"), F.length(part[3]).alias("fraction"), F.coalesce(F.nullif(part[4], F.lit("")).try_cast("decimal(20,0)"), F.lit(0)).alias("e"))

    def shown(p: Column) -> Column:
        kept = F.regexp_replace(p["digits"], "^0+", "")
        return let(F.struct(kept.alias("kept"), F.regexp_replace(kept, "0+$", "").alias("short")), lambda k: F.when(k["short"] == "", F.lit("0")).otherwise(
            F.concat(F.when(p["sign"] == "-", "-").otherwise(""), k["short"], F.lit("e"), (p["e"] - p["fraction"] + F.length(k["kept"]) - F.length(k["short"])).cast("decimal(21,0)").cast("string"))))

    return F.when(lex.rlike(number), let(parts, lambda p: F.when(p["digits"] != "", shown(p))))


def canonical_xsd(lex: Column) -> Column:
    """xsd:int, xsd:long or xsd:integer for a whole number of any length, by size."""
    digits = F.regexp_replace(F.regexp_replace(F.trim(lex), r"^[+-]", ""), "^0+(?=.)", "")

    def size(d: Column) -> Column:
        negative = d["negative"]

        def fits(bits: int) -> Column:
            top = F.when(negative, F.lit(str(2**bits))).otherwise(F.lit(str(2**bits - 1))).cast("decimal(20,0)")
            return F.coalesce(d["n"] <= top, F.lit(False))

        return F.when(fits(31), "xsd:int").when(fits(63), "xsd:long").otherwise("xsd:integer")

    number = F.when(F.length(digits) < 20, digits.try_cast("decimal(20,0)"))
    return let(F.struct(number.alias("n"), F.startswith(F.trim(lex), F.lit("-")).alias("negative")), size)


def parse_boolean(lex: Column) -> Column:
    """true for true and 1, false for false and 0, in any case; else null."""
    low = F.lower(lex)
    return F.when(low.isin("true", "1"), True).when(low.isin("false", "0"), False)


def isoformat(ts: Column) -> Column:
    """ISO text of a timestamp_ntz: no fraction, or all six digits of one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.regexp_replace(whole, r"\.000000$", "")


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def time_of(ts: Column) -> Column:
    """A naive time from a timestamp_ntz; null stays null."""
    ts = ts.cast("timestamp_ntz")
    return F.when(ts.isNotNull(), F.struct(isoformat(ts).alias("lex"), _micros(ts).alias("micros"), F.lit(False).alias("aware")))


def parse_datetime(lex: Column) -> Column:
    """A time from xsd:dateTime text, or null. A `T` is needed; seconds may be left out;
    of a fraction six digits count; 24:00:00 is the next day's midnight; Z or an offset
    makes it aware."""
    s = F.trim(lex)
    form = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2})(?::([0-9]{2})(?:\.([0-9]+))?)?(Z|[+-][0-9]{2}:[0-9]{2})?$"
    names = ("day", "clock", "second", "fraction", "zone")
    parts = F.struct(*[F.regexp_extract(s, form, i + 1).alias(n) for i, n in enumerate(names)])

    def moment(p: Column) -> Column:
        midnight = (p["clock"] == "24:00") & (p["second"] == "00") & (F.regexp_replace(p["fraction"], "0+", "") == "")
        shown = F.concat(p["day"], F.lit(" "), F.when(midnight, F.lit("00:00")).otherwise(p["clock"]), F.lit(":"), F.when(p["second"] == "", "00").otherwise(p["second"]), F.lit("."), F.substring(F.rpad(p["fraction"], 6, "0"), 1, 6))
        zone = p["zone"]
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        offset = F.when(F.length(zone) == 6, (hours * 60 + minutes) * F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)).otherwise(0)
        good = (F.length(zone) < 2) | ((hours < 24) & (minutes < 60))
        return F.struct(shown.try_cast("timestamp_ntz").alias("naive"), midnight.alias("midnight"), offset.alias("offset"), good.alias("good"), F.when(zone == "Z", "+00:00").otherwise(zone).alias("zone"))

    def made(m: Column) -> Column:
        local = F.when(m["midnight"], m["naive"] + F.expr("interval 1 day")).otherwise(m["naive"])
        micros = _micros(local) - m["offset"].cast("long") * 60_000_000
        return F.when(m["good"] & m["naive"].isNotNull(), F.struct(F.concat(isoformat(local), m["zone"]).alias("lex"), micros.alias("micros"), (m["zone"] != "").alias("aware")))

    return F.when(s.rlike(form), let(let(parts, moment), made))


def require_datetime(lex: Column) -> Column:
    """parse_datetime(), but text that is no date-time raises when it is computed; null stays null."""
    return F.when(lex.isNotNull(), F.coalesce(parse_datetime(lex), F.raise_error(F.concat(F.lit("no date and time: "), lex)).cast(TIME)))


def float_text(x: Column) -> Column:
    """Shortest text of a double as in the textual notation: plain for decimal exponents
    from -4 to 15, else like 1e+16, with two exponent digits at least. Digits are the JVM's,
    which before version 19 has one too many for a few numbers; they read back equal."""
    form = r"^-?([0-9]+)\.([0-9]+)(?:E(-?[0-9]+))?$"

    def parts(s: Column) -> Column:
        whole, rest, power = (F.regexp_extract(s, form, i) for i in (1, 2, 3))
        return F.struct(s.alias("s"), F.when(F.startswith(s, F.lit("-")), "-").otherwise("").alias("sign"), whole.alias("whole"), F.when(rest == "0", "").otherwise(rest).alias("rest"), F.coalesce(power.try_cast("int"), F.lit(0)).alias("e"))

    def shown(p: Column) -> Column:
        e, digits = p["e"], F.concat(p["whole"], p["rest"])
        large = F.concat(F.substr(F.rpad(digits, 30, "0"), F.lit(1), e + 1), F.lit("."), F.coalesce(F.nullif(F.substr(digits, e + 2), F.lit("")), F.lit("0")))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        mantissa = F.concat_ws(".", p["whole"], F.nullif(p["rest"], F.lit("")))
        power = F.when(F.abs(e) < 10, F.lpad(F.abs(e).cast("string"), 2, "0")).otherwise(F.abs(e).cast("string"))
        science = F.concat(mantissa, F.lit("e"), F.when(e < 0, "-").otherwise("+"), power)
        plain = F.regexp_replace(p["s"], "^-", "")
        text = F.when(e == 0, plain).when((e > 0) & (e < 16), large).when((e < 0) & (e >= -4), small).otherwise(science)
        odd = F.when(p["s"] == "NaN", "nan").when(p["s"] == "Infinity", "inf").when(p["s"] == "-Infinity", "-inf")
        return F.coalesce(odd, F.concat(p["sign"], text))

    return let(let(x.cast("double").cast("string"), parts), shown)


# values


def value(kind: str, lex: Column, datatype: str | None = None, lang: Column | None = None, cmp=None) -> Column:
    """A value; cmp makes what it is compared by from its text, the text itself by default."""

    def made(x: Column) -> Column:
        own = x if cmp is None else cmp(x)
        return F.when(x.isNotNull(), F.struct(F.lit(kind).alias("kind"), x.alias("lex"), F.lit(datatype).cast("string").alias("datatype"), (F.lit(None).cast("string") if lang is None else lang).alias("lang"), own.alias("cmp")))

    return let(lex, made)


def v_str(x: Column | str) -> Column:
    return value("str", text(x))


def v_int(x: Column | int) -> Column:
    return value("int", text(x if isinstance(x, Column) else F.lit(x)), cmp=canonical_decimal)


def v_float(x: Column) -> Column:
    return value("float", float_text(x), cmp=lambda t: F.when(t == "-0.0", "0.0").otherwise(t))


def v_bool(x: Column) -> Column:
    return value("bool", F.when(x, "true").when(~x, "false"))


def v_iri(uri: Column) -> Column:
    return value("iri", uri)


def v_qname(n: Column) -> Column:
    return let(n, lambda m: value("qname", name_text(m), cmp=lambda _: m["uri"]))


def v_datetime(t: Column) -> Column:
    return let(t, lambda m: value("datetime", m["lex"], cmp=lambda _: F.concat(F.when(m["aware"], "A").otherwise("N"), m["micros"].cast("string"))))


def v_literal(lex: Column, datatype: str, lang: Column | None = None) -> Column:
    """A literal with a datatype uri; a language tag forces the datatype of language strings."""
    number = datatype == XSD + "decimal"
    if lang is not None:
        datatype = PROV + "InternationalizedString"
    tag = F.lit("") if lang is None else F.coalesce(F.lower(lang), F.lit(""))
    return value("literal", lex, datatype, lang, lambda x: F.concat_ws("|", F.lit(datatype), tag, F.coalesce(canonical_decimal(x), x) if number else x))


def quote(s: Column) -> Column:
    """In double quotes, three of them around several lines; backslash and quote escaped."""
    escaped = F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.when(F.contains(s, F.lit("\n")), F.concat(F.lit('"""'), escaped, F.lit('"""'))).otherwise(F.concat(F.lit('"'), escaped, F.lit('"')))


def datatype_text(uri: Column) -> Column:
    return F.when(F.startswith(uri, F.lit(XSD)), F.concat(F.lit("xsd:"), local_in(uri, F.lit(XSD)))).when(F.startswith(uri, F.lit(PROV)), F.concat(F.lit("prov:"), local_in(uri, F.lit(PROV)))).otherwise(uri)


def provn_value(v: Column) -> Column:
    """Text of a value in the textual notation."""
    lex = v["lex"]
    typed = lambda kind: F.concat(F.lit('"'), lex, F.lit(f'" %% {kind}'))
    size = canonical_xsd(lex)
    lang = F.coalesce(v["lang"], F.lit(""))
    literal = F.when(lang != "", F.concat(quote(lex), F.lit("@"), lang)).otherwise(F.concat(quote(lex), F.lit(" %% "), datatype_text(v["datatype"])))
    return (
        F.when(v["kind"] == "str", quote(lex))
        .when(v["kind"] == "datetime", typed("xsd:dateTime"))
        .when(v["kind"] == "float", typed("xsd:double"))
        .when(v["kind"] == "bool", F.when(lex == "true", '"1" %% xsd:boolean').otherwise('"0" %% xsd:boolean'))
        .when(v["kind"] == "int", F.when(size == "xsd:int", lex).otherwise(F.concat(F.lit('"'), lex, F.lit('" %% '), size)))
        .when(v["kind"] == "iri", F.concat(F.lit('"'), lex, F.lit('" %% xsd:anyURI')))
        .when(v["kind"] == "qname", F.concat(F.lit("'"), lex, F.lit("'")))
        .otherwise(literal)
    )


def attribute(attr: Column, v: Column) -> Column:
    return F.struct(attr.alias("name"), v.alias("value"))


def attributes(*pairs: tuple[Column, Column]) -> Column:
    """The attributes of a record; those with a null value are left out."""
    if not pairs:
        return F.array().cast(ATTRS)
    return F.filter(F.array(*[attribute(n, v) for n, v in pairs]), lambda a: a["value"].isNotNull())


def distinct_attributes(attrs: Column) -> Column:
    """The first of attributes with the same name, kind and cmp, in order."""
    key = lambda a: F.concat_ws("\x1f", a["name"]["uri"], a["value"]["kind"], a["value"]["cmp"])
    bound = F.array(F.struct(attrs.alias("a"), F.transform(attrs, key).alias("k")))
    return F.transform(bound, lambda s: F.filter(s["a"], lambda a, i: F.array_position(s["k"], s["k"][i]) == i + 1))[0]
