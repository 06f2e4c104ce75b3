"""Namespaces and the resolution of names, as joins and column functions.

namespaces: doc_id, scope, seq (order of registration), prefix ('' for the default), uri.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.catalog import PROV, XSD, XSI

SCHEMA = "doc_id string, scope string, seq bigint, prefix string, uri string"

# Registered before any other, in this order.
BUILT_IN = (("prov", PROV), ("xsd", XSD), ("xsi", XSI))

TABLE = "array<struct<prefix:string,uri:string>>"


def tables(namespaces: DataFrame) -> DataFrame:
    """(doc_id, scope, own): the namespaces of each scope in order of registration. A
    scope has few, so the array is small. Of one prefix the first uri stays (a default is
    overwritten: the last stays)."""
    one = namespaces.where("trim(uri) <> ''")
    # a default may be set again, a prefix keeps its first uri
    kept = one.groupBy("doc_id", "scope", "prefix").agg(F.when(F.first("prefix") == "", F.max_by("uri", "seq")).otherwise(F.min_by("uri", "seq")).alias("uri"), F.min("seq").alias("seq"))
    return kept.groupBy("doc_id", "scope").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "prefix", "uri"))), lambda n: F.struct(n["prefix"].alias("prefix"), n["uri"].alias("uri"))).alias("own"))


def _built_in() -> Column:
    return F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(u).alias("uri")) for p, u in BUILT_IN]).cast(TABLE)


def resolve(text: Column, own: Column, parent: Column | None = None) -> Column:
    """The name that text stands for, or null: a known prefix before the first colon; else
    the first registered namespace that the whole text starts with; without a colon the
    default namespace; else the same in the parent's. Blank nodes (`_:`) have none."""
    levels = [own] + ([parent] if parent is not None else [])
    given = F.struct(text.alias("t"), *[F.coalesce(x, F.array().cast(TABLE)).alias(f"l{i}") for i, x in enumerate(levels)])

    def at(level: str):
        def found(g: Column) -> Column:
            t, head = g["t"], F.substring_index(g["t"], ":", 1)
            every = F.concat(_built_in(), g[level])
            known = F.get(F.filter(every, lambda n: (n["prefix"] == head) & (n["prefix"] != "")), 0)
            inside = F.get(F.filter(every, lambda n: (n["prefix"] != "") & F.startswith(t, n["uri"])), 0)
            default = F.get(F.filter(g[level], lambda n: n["prefix"] == ""), 0)

            def named(n: Column, local) -> Column:
                return V.let(n, lambda m: F.when(m.isNotNull(), F.struct(F.concat(m["uri"], local(m)).alias("uri"), m["prefix"].alias("prefix"), local(m).alias("local"))))

            by_prefix = named(known, lambda m: F.substr(t, F.length(head) + 2))
            # every occurrence of the namespace is cut, as the data model's resolution does
            by_uri = named(inside, lambda m: F.replace(t, m["uri"], F.lit("")))
            return F.when(F.contains(t, F.lit(":")), F.coalesce(by_prefix, by_uri)).otherwise(named(default, lambda m: t))

        return found

    made = V.let(given, lambda g: F.coalesce(*[at(f"l{i}")(g) for i in range(len(levels))]))
    return F.when((text != "") & ~F.startswith(text, F.lit("_:")), made).cast(V.NAME)


def require(text: Column, own: Column, parent: Column | None = None) -> Column:
    """resolve(), but a name that nothing explains raises when it is computed; null stays null."""
    return F.when(text.isNotNull(), F.coalesce(resolve(text, own, parent), F.raise_error(F.concat(F.lit("unknown name "), text)).cast(V.NAME)))


def first_match(uris: DataFrame, namespaces: DataFrame, uri_col: str = "uri") -> DataFrame:
    """uris with ns_prefix and local of the first registered namespace that the uri starts with; null without one."""
    return _match(uris, namespaces, uri_col, lambda n: F.min_by(n, "seq"))


def longest_match(uris: DataFrame, namespaces: DataFrame, uri_col: str = "uri") -> DataFrame:
    """uris with ns_prefix and local of the longest namespace that the uri starts with; null without one."""
    return _match(uris, namespaces, uri_col, lambda n: F.max_by(n, F.struct(F.length("ns_uri"), -F.col("seq"))))


def _match(uris: DataFrame, namespaces: DataFrame, uri_col: str, pick) -> DataFrame:
    """Joins on the lengths that namespaces have: a uri is cut to each, so it is an equi-join.
    Uris with a doc_id are matched with the namespaces of their document."""
    doc = ["doc_id"] if "doc_id" in uris.columns else []
    named = namespaces.select(*doc, "seq", F.col("prefix").alias("ns_prefix"), F.col("uri").alias("ns_uri")).where("ns_uri <> ''")
    lengths = [r[0] for r in named.select(F.length("ns_uri")).distinct().orderBy(F.length("ns_uri")).collect()]  # a few numbers
    one = uris.select(*doc, F.col(uri_col).alias("uri")).distinct()
    cut = one.select(*doc, "uri", F.explode(F.array(*[F.substring("uri", 1, n) for n in lengths]) if lengths else F.array().cast("array<string>")).alias("ns_uri")).where("uri is not null").distinct()
    best = cut.join(named, [*doc, "ns_uri"]).groupBy(*doc, "uri").agg(pick(F.struct("ns_prefix", "ns_uri")).alias("n"))
    out = best.select(*doc, F.col("uri").alias(uri_col), F.col("n.ns_prefix").alias("ns_prefix"), F.substr("uri", F.length("n.ns_uri") + 1).alias("local"))
    return uris.join(out, [*doc, uri_col], "left")


def scope_labels(scopes: DataFrame, namespaces: DataFrame | None) -> DataFrame:
    """(doc_id, scope, ...) with the bundle's name as its document writes it, as `label`: by
    the longest of the document's own namespaces, or the uri where none fits."""
    if namespaces is None:
        return scopes.withColumn("label", F.col("scope"))
    # a document has few namespaces of its own, so the array is small
    fact = F.struct(F.length("uri").alias("n"), (-F.col("seq")).alias("order"), "prefix", "uri")
    own = namespaces.where("scope = '' and uri <> ''").groupBy("doc_id").agg(F.collect_list(fact).alias("__own"))
    best = F.array_max(F.filter("__own", lambda n: F.startswith(F.col("scope"), n["uri"])))
    local = F.substr("scope", best["n"] + 1)
    name = F.when(F.coalesce(local, F.lit("")) == "", F.col("scope")).when(best["prefix"] == "", local).otherwise(F.concat_ws(":", best["prefix"], local))
    return scopes.join(own, "doc_id", "left").withColumn("label", name).drop("__own")


# Combining the namespaces of documents

_ROOT = r"^(.*?)(?:_[0-9]+)*$"


def register(declared: DataFrame) -> DataFrame:
    """declared (doc_id, scope, seq, prefix, uri, ...) with as_prefix, the prefix under which each
    namespace ends up when all are registered in order of seq, scope by scope.

    A uri that is known keeps its first prefix. A prefix that another uri has is renamed: p
    becomes p_1, or p_2 if that is taken too, and so on. prov, xsd and xsi are taken from the
    start. The first default namespace (prefix '') is the scope's; another one is registered
    as dn. Declarations of equal seq are ordered by prefix and uri; blank uris are left out.

    Names only clash within one prefix, unless it looks like a renamed one (p and p_1 in one
    scope). So clashes are numbered by ranges of the whole table, whatever the size of a
    scope; only the prefixes of a scope that could meet renamed ones are assigned one by one.
    """
    from .numbering import number_rows

    key = ["doc_id", "scope"]
    asked = declared.where("trim(uri) <> ''")
    order = F.struct("seq", "prefix", "uri")
    defaults = asked.where("prefix = ''").groupBy(*key).agg(F.min_by("uri", order).alias("default_uri"))
    asked = asked.join(defaults, key, "left").withColumn("asked", F.when(F.col("prefix") != "", F.col("prefix")).when(F.col("uri") == F.col("default_uri"), "").otherwise("dn"))
    built_in = F.lit(False)
    for prefix, uri in BUILT_IN:
        built_in = built_in | ((F.col("asked") == prefix) & (F.col("uri") == uri))
    new = asked.where(~built_in & (F.col("asked") != ""))
    # the first declaration of a uri decides
    first = new.groupBy(*key, "uri").agg(F.min(F.struct("seq", "asked")).alias("first")).select(*key, "uri", F.col("first.seq").alias("seq"), F.col("first.asked").alias("asked"))
    first = first.withColumn("root", F.regexp_extract("asked", _ROOT, 1))
    mixed = first.where("root <> asked").select(*key, "root").distinct()
    plain = first.join(mixed, [*key, "root"], "left_anti")
    numbered = number_rows(plain, ["seq", "uri"], "__n", within=[*key, "asked"])
    # a built-in prefix is taken by the built-in namespace
    nth = F.col("__n") - F.when(F.col("asked").isin([p for p, _ in BUILT_IN]), 0).otherwise(1)
    numbered = numbered.select(*key, "uri", F.when(nth == 0, F.col("asked")).otherwise(F.concat_ws("_", "asked", nth.cast("string"))).alias("__as"))
    followed = first.join(mixed, [*key, "root"], "left_semi").groupBy(*key, "root").applyInPandas(_one_by_one, f"{_types(first, key)}, uri string, __as string")
    given = numbered.unionByName(followed)
    out = asked.join(given, [*key, "uri"], "left").withColumn("as_prefix", F.when(F.col("asked") == "", "").when(built_in, F.col("asked")).otherwise(F.col("__as")))
    return out.select(*declared.columns, "as_prefix")


def _types(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def _one_by_one(group):
    """Prefixes of one scope that differ in numbers at their end only, in order."""
    taken = {p for p, _ in BUILT_IN}
    given, free = [], {}
    for asked in (group := group.sort_values(["seq", "asked", "uri"]))["asked"]:
        name, n = asked, free.get(asked, 1)
        while name in taken:
            name, n = f"{asked}_{n}", n + 1
        free[asked] = n if name != asked else 1
        taken.add(name)
        given.append(name)
    return group.assign(__as=given)[["doc_id", "scope", "uri", "__as"]]


def union(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(namespaces, renamed): the namespaces of one, then those of other under prefixes that
    don't clash, in one order of registration; and what became of other's declarations
    (doc_id, scope, prefix, uri, as_prefix). Both are written once and read back."""
    from .scratch import settle

    columns = ["doc_id", "scope", "seq", "prefix", "uri"]
    last = one.groupBy("doc_id", "scope").agg((F.max("seq") + 1).alias("__last"))
    after = other.join(last, ["doc_id", "scope"], "left").withColumn("seq", F.col("seq") + F.coalesce("__last", F.lit(0)))
    both = one.select(*columns, F.lit(False).alias("late")).unionByName(after.select(*columns, F.lit(True).alias("late")))
    done = settle(register(both), "namespaces")
    kept = done.groupBy("doc_id", "scope", "uri", "as_prefix").agg(F.min("seq").alias("seq"))
    return kept.select("doc_id", "scope", "seq", F.col("as_prefix").alias("prefix"), "uri"), done.where("late").select("doc_id", "scope", "prefix", "uri", "as_prefix")


def renamed_name(n: Column, changes: Column) -> Column:
    """The name with the prefix that its namespace has now. changes: map of `prefix uri` to prefix."""
    space = lambda m: F.substr(m["uri"], F.lit(1), F.length(m["uri"]) - F.length(m["local"]))
    return V.let(n, lambda m: F.when(m.isNotNull(), F.struct(m["uri"].alias("uri"), F.coalesce(changes[F.concat_ws(" ", m["prefix"], space(m))], m["prefix"]).alias("prefix"), m["local"].alias("local"))).cast(V.NAME))


def rename(records: DataFrame, renamed: DataFrame) -> DataFrame:
    """records with the prefixes that `renamed` gives them, in identifiers, formal names,
    attribute names and values that are names. A name of a bundle goes by its own namespaces
    first, then by its document's. The changed prefixes of one scope are carried in its rows."""
    from .records import ARGS

    changed = renamed.where("prefix <> as_prefix").groupBy("doc_id", "scope").agg(F.collect_set(F.struct(F.concat_ws(" ", "prefix", "uri").alias("k"), F.col("as_prefix").alias("v"))).alias("c"))
    # a prefix may have been declared twice with different uris, never one uri under two results
    own = changed.select("doc_id", "scope", F.map_from_entries("c").alias("__own"))
    of_document = changed.where("scope = ''").select("doc_id", F.map_from_entries("c").alias("__doc"))
    joined = records.join(own, ["doc_id", "scope"], "left").join(of_document, "doc_id", "left")
    none = F.create_map().cast("map<string,string>")
    # the scope's own entries go before the document's
    inherited = F.map_filter(F.coalesce("__doc", none), lambda k, v: ~F.coalesce(F.map_contains_key(F.coalesce("__own", none), k), F.lit(False)))
    joined = joined.withColumn("__changes", F.map_concat(F.coalesce("__own", none), inherited))
    changes = F.col("__changes")

    def value(v: Column) -> Column:
        # a value that is a name has its text in lex and its uri in cmp
        local = F.when(F.contains(v["lex"], F.lit(":")), F.substr(v["lex"], F.length(F.substring_index(v["lex"], ":", 1)) + 2)).otherwise(v["lex"])
        prefix = F.when(F.contains(v["lex"], F.lit(":")), F.substring_index(v["lex"], ":", 1)).otherwise("")
        now = renamed_name(F.struct(v["cmp"].alias("uri"), prefix.alias("prefix"), local.alias("local")), changes)
        return F.struct(v["kind"].alias("kind"), F.when(v["kind"] == "qname", V.name_text(now)).otherwise(v["lex"]).alias("lex"), v["datatype"].alias("datatype"), v["lang"].alias("lang"), v["cmp"].alias("cmp"))

    attrs = F.transform("attrs", lambda a: F.struct(renamed_name(a["name"], changes).alias("name"), value(a["value"]).alias("value"))).cast(V.ATTRS)
    cells = {c: renamed_name(F.col(c), changes) for c in ("id", *ARGS)} | {"attrs": attrs}
    return joined.select(*[cells[c].alias(c) if c in cells else F.col(c) for c in records.columns])


def combine(records: DataFrame, namespaces: DataFrame, other: DataFrame, other_namespaces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, namespaces) of documents updated with others of the same doc_id: bundles of
    one uri become one, and names of `other` are written with prefixes that don't clash."""
    from .setops import update

    spaces, renamed = union(namespaces, other_namespaces)
    return update(records, rename(other, renamed)), spaces
