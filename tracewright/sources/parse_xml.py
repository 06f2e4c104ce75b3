"""Parser of the XML notation: text to flat rows. Document types and entities are refused."""

from __future__ import annotations

import re
from collections.abc import Iterator
from io import BytesIO
from xml.etree import ElementTree

from ..functions.catalog import KIND_OF_KEYWORD, KINDS, PROV, SUBTYPES, XSD, XSI

_XSD_BARE = XSD.rstrip("#")
_SUBTYPE_OF_KEYWORD = {word: (sub, kind) for sub, (word, kind) in SUBTYPES.items()}
_ESCAPE = re.compile("_x([0-9A-Fa-f]{8}|[0-9A-Fa-f]{4})_")


def unescape_name(local: str) -> str:
    """Characters that an XML name cannot have are written _xHHHH_ or _xHHHHHHHH_."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), local)


class _Names:
    """Prefixes of the whole document; a prefix that is bound again to another uri gets a new one."""

    def __init__(self):
        self.of: dict[str, str] = {}

    def prefix(self, uri: str, wanted: str) -> str:
        for p, u in self.of.items():
            if u == uri and p:
                return p
        p, n = wanted or "ns", 0
        while p in self.of and self.of[p] != uri:
            n += 1
            p = f"{wanted or 'ns'}_{n}"
        self.of[p] = uri
        return p


def prov_xml(text: str) -> Iterator[dict]:
    if "<!DOCTYPE" in text or "<!ENTITY" in text:
        raise ValueError("document types are not read")
    rows, names = list(_walk(text)), _Names()
    return iter(_bound(rows, names))


def _walk(text: str):
    """(element, in-scope prefixes, path) of the children of containers, as they end."""
    spaces: list[tuple[str, str]] = [("xml", "http://www.w3.org/XML/1998/namespace")]
    stack: list[tuple] = []
    for event, item in ElementTree.iterparse(BytesIO(text.encode()), events=("start-ns", "end-ns", "start", "end")):
        if event == "start-ns":
            spaces.append(item)
        elif event == "end-ns":
            spaces.pop()
        elif event == "start":
            stack.append((item, dict(spaces)))
        else:
            _, scope = stack.pop()
            item.set("{}ns", scope)
            yield item, len(stack)


def _bound(events, names: _Names) -> list[dict]:
    root = events[-1][0] if events else None
    if root is None or root.tag != f"{{{PROV}}}document":
        raise ValueError("the root is not prov:document")
    rows: list[dict] = []
    _children(root, "", rows, names)
    seen = [{"what": "binding", "scope": "", "attr": p, "lex": u, "pos": i} for i, (p, u) in enumerate(names.of.items())]
    return seen + rows


def _split(tag: str) -> tuple[str, str]:
    uri, _, local = tag[1:].partition("}")
    return uri, unescape_name(local)


def _written(name: str, ns: dict, names: _Names, attribute: bool = False) -> str:
    """A QName of the text with a prefix of the whole document; unknown ones as they are."""
    prefix, colon, local = name.partition(":")
    if not colon:
        prefix, local = "", name
    uri = ns.get(prefix)
    if uri is None:
        return name
    uri = XSD if uri == _XSD_BARE else uri
    return f"{_builtin(uri) or names.prefix(uri, prefix)}:{unescape_name(local)}"


def _builtin(uri: str) -> str | None:
    return {PROV: "prov", XSD: "xsd", XSI.rstrip("#"): "xsi"}.get(uri)


def _children(container, scope: str, rows: list[dict], names: _Names) -> None:
    seq = 0
    for child in container:
        uri, word = _split(child.tag)
        if uri != PROV:
            raise ValueError(f"{child.tag} is not of the notation")
        if word == "other":
            continue
        ns = child.get("{}ns")
        ident = child.get(f"{{{PROV}}}id")
        if word == "bundleContent":
            if scope:
                raise ValueError("a bundle cannot hold bundles")
            rows.append({"what": "bundle", "scope": _written(ident, ns, names)})
            _children(child, _written(ident, ns, names), rows, names)
            continue
        subtype, kind = _SUBTYPE_OF_KEYWORD.get(word, (None, KIND_OF_KEYWORD.get(word)))
        if kind is None:
            raise ValueError(f"unknown element {word}")
        base = {"scope": scope, "seq": seq, "rtype": kind, "id": ident and _written(ident, ns, names)}
        seq += 1
        rows.append(base | {"what": "statement", "pos": 0})
        pos = 0
        if subtype:
            pos += 1
            rows.append(base | {"what": "attribute", "attr": "prov:type", "pos": pos, "form": "ref", "lex": f"prov:{subtype}"})
        if (typed := child.get(f"{{{XSI.rstrip('#')}}}type")) is not None:
            pos += 1
            rows.append(base | {"what": "attribute", "attr": "prov:type", "pos": pos, "form": "ref", "lex": _written(typed, ns, names)})
        for part in child:
            pos += 1
            rows.append(base | {"what": "attribute", "pos": pos} | _attribute(part, kind, names))


def _attribute(part, kind: str, names: _Names) -> dict:
    uri, local = _split(part.tag)
    ns = part.get("{}ns")
    known = _builtin(uri) or names.prefix(uri, next((p for p, u in ns.items() if u == uri and p), ""))
    row = {"attr": f"{known}:{local}", "lex": part.text or ""}
    ref, typed, lang = part.get(f"{{{PROV}}}ref"), part.get(f"{{{XSI.rstrip('#')}}}type"), part.get("{http://www.w3.org/XML/1998/namespace}lang")
    if ref is not None:
        formal = uri == PROV and local in KINDS[kind][1]
        return row | {"form": "str" if formal else "ref", "lex": _written(ref, ns, names)}
    if typed is not None:
        datatype = _written(typed, ns, names)
        lex = _written(row["lex"].strip(), ns, names) if datatype in ("xsd:QName", "prov:QUALIFIED_NAME") else row["lex"]
        return row | {"form": "typed", "lex": lex, "datatype": datatype, "lang": lang}
    return row | {"form": "typed" if lang else "str", "lang": lang}
