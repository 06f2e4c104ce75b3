"""Parsers of the two JSON notations: text to flat rows, names as written."""

from __future__ import annotations

import json
from collections.abc import Iterator

from ..functions.catalog import ELEMENTS, KIND_OF_KEYWORD, KINDS, PROV


def _scalar(value) -> dict:
    if isinstance(value, bool):
        return {"form": "bool", "lex": "true" if value else "false"}
    if isinstance(value, int):
        return {"form": "int", "lex": str(value)}
    if isinstance(value, float):
        return {"form": "float", "lex": repr(value)}
    if isinstance(value, str):
        return {"form": "str", "lex": value}
    raise ValueError(f"no attribute value: {value!r}")


def prov_json(text: str) -> Iterator[dict]:
    """PROV-JSON: keyword -> identifier -> attributes, or a list of such."""
    document = json.loads(text)
    if not isinstance(document, dict):
        raise ValueError("a document is an object")
    yield from _container(document, "")
    for name, inner in _object(document.get("bundle", {}), "bundle").items():
        if "bundle" in _object(inner, name):
            raise ValueError("a bundle cannot hold bundles")
        yield {"what": "bundle", "scope": name}
        yield from _container(inner, name)


def _object(value, where: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{where} is not an object")
    return value


def _container(container: dict, scope: str) -> Iterator[dict]:
    for i, (prefix, uri) in enumerate(_object(container.get("prefix", {}), "prefix").items()):
        yield {"what": "binding", "scope": scope, "attr": "" if prefix == "default" else prefix, "lex": uri, "pos": i}
    seq = 0
    for word, group in container.items():
        if word in ("prefix", "bundle"):
            continue
        if word not in KIND_OF_KEYWORD:
            raise ValueError(f"unknown keyword {word}")
        for ident, found in _object(group, word).items():
            for instance in found if isinstance(found, list) else [found]:
                for one in _members(word, _object(instance, ident)):
                    yield from _statement(scope, seq, KIND_OF_KEYWORD[word], ident, one)
                    seq += 1


def _members(word: str, instance: dict) -> list[dict]:
    """A membership of several entities is as many memberships."""
    entities = instance.get("prov:entity")
    if word != "hadMember" or not isinstance(entities, list):
        return [instance]
    first = instance | {"prov:entity": entities[:1]}
    return [first] + [{"prov:collection": instance.get("prov:collection"), "prov:entity": e} for e in entities[1:]]


_FORMAL = {f"prov:{a}" for _, formals in KINDS.values() for a in formals}


def _statement(scope: str, seq: int, rtype: str, ident: str, instance: dict) -> Iterator[dict]:
    base = {"scope": scope, "seq": seq, "rtype": rtype, "id": None if ident.startswith("_:") else ident}
    if rtype in ELEMENTS and base["id"] is None:
        raise ValueError(f"{rtype} needs an identifier")
    yield base | {"what": "statement", "pos": 0}
    pos = 0
    for attr, values in instance.items():
        many = values if isinstance(values, list) else [values]
        if attr in _FORMAL and len(many) > 1:
            raise ValueError(f"{attr} has several values")
        for value in many:
            pos += 1
            row = base | {"what": "attribute", "attr": attr, "pos": pos}
            if attr in _FORMAL:
                if value is not None:
                    yield row | {"form": "str", "lex": str(value)}
            elif isinstance(value, dict):
                if "$" not in value:
                    raise ValueError(f'{attr} lacks "$"')
                plain = value["$"]
                lex = _scalar(plain)["lex"] if not isinstance(plain, str) else plain
                yield row | {"form": "typed", "lex": lex, "datatype": value.get("type"), "lang": value.get("lang")}
            else:
                yield row | _scalar(value)


# Bare terms of the JSON-LD notation that are attributes of the data model.
_TERMS = {"type": "prov:type", "label": "prov:label", "value": "prov:value", "location": "prov:location", "role": "prov:role"}
_NAMED = {"type", "location", "role"}


def prov_jsonld(text: str) -> Iterator[dict]:
    """The compacted JSON-LD notation: a context of prefixes and a graph of statements."""
    document = json.loads(text)
    if not isinstance(document, dict) or "@context" not in document or "@graph" not in document:
        raise ValueError("a document has @context and @graph")
    yield from _graph(document, "")


def _graph(container: dict, scope: str) -> Iterator[dict]:
    context = container.get("@context", [])
    n = 0
    for part in context if isinstance(context, list) else [context]:
        if isinstance(part, dict) and sum(isinstance(part.get(k), dict) for k in KINDS) * 2 <= len(KINDS):
            for prefix, uri in part.items():
                if isinstance(uri, str) and prefix != "@base":
                    yield {"what": "binding", "scope": scope, "attr": "" if prefix == "@vocab" else prefix, "lex": uri, "pos": n}
                    n += 1
    graph = container.get("@graph", [])
    if not isinstance(graph, list):
        raise ValueError("@graph is not a list")
    for seq, item in enumerate(graph):
        kind = _bare(_object(item, "statement").get("@type"))
        if kind == "Bundle" and "@graph" in item:
            if scope:
                raise ValueError("a bundle cannot hold bundles")
            yield {"what": "bundle", "scope": item["@id"]}
            yield from _graph(item, item["@id"])
            continue
        if kind == "Mention" or kind not in KINDS:
            raise ValueError(f"no statement type: {kind}")
        yield from _ld_statement(scope, seq, kind, item)


def _bare(term):
    for prefix in ("prov:", PROV):
        if isinstance(term, str) and term.startswith(prefix):
            return term[len(prefix) :]
    return term


def _ld_statement(scope: str, seq: int, kind: str, item: dict) -> Iterator[dict]:
    ident = item.get("@id")
    base = {"scope": scope, "seq": seq, "rtype": kind, "id": None if not ident or ident.startswith("_:") else ident}
    if kind in ELEMENTS and base["id"] is None:
        raise ValueError(f"{kind} needs an identifier")
    yield base | {"what": "statement", "pos": 0}
    pos = 0
    for key, values in item.items():
        if key.startswith("@"):
            continue
        term = _bare(key)
        if term in KINDS[kind][1]:
            if isinstance(values, list):
                raise ValueError(f"{key} is a list")
            pos += 1
            yield base | {"what": "attribute", "attr": f"prov:{term}", "pos": pos, "form": "str", "lex": values}
            continue
        if not isinstance(values, list):
            raise ValueError(f"{key} is not a list")
        attr = _TERMS.get(term, key)
        for value in values:
            pos += 1
            row = base | {"what": "attribute", "attr": attr, "pos": pos}
            if isinstance(value, dict):
                plain = value["@value"]
                lex = plain if isinstance(plain, str) else _scalar(plain)["lex"]
                typed = value.get("@type") or value.get("@language")
                yield row | {"form": "typed" if typed else "str", "lex": lex, "datatype": value.get("@type"), "lang": value.get("@language")}
            else:
                yield row | ({"form": "ref", "lex": value} if term in _NAMED and isinstance(value, str) else _scalar(value))
