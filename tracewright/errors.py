"""Exceptions of the engine. What is wrong with rows is told by rows; these are raised on request, or for what a caller asks."""


class ProvenanceError(Exception):
    """Any of the below."""


class ProvenanceWarning(Warning):
    """Something of a document was left out."""


class UnreadableText(ProvenanceError):
    """A text that no reader of its format accepts."""


class InvalidName(ProvenanceError):
    """A name that no namespace explains where one is needed."""


class InvalidValue(ProvenanceError):
    """A time, number or truth value that is none."""


class IdentifierRequired(ProvenanceError):
    """An element without an identifier."""


class CannotUnify(ProvenanceError):
    """Two values where a statement can have one, or kinds that can't share an identifier."""


#: The class that a row of statements.violations() or unify.violations() stands for.
OF_KIND = {"text": UnreadableText, "name": InvalidName, "time": InvalidValue, "value": InvalidValue, "identifier": IdentifierRequired, "repeated": CannotUnify, "conflict": CannotUnify, "types": CannotUnify}


def raise_first(violations) -> None:
    """Raises the first violation (by document and place) as an exception, if there is any."""
    order = [c for c in ("doc_id", "scope", "seq", "id", "kind", "detail") if c in violations.columns]
    for row in violations.orderBy(*order).limit(1).collect():
        place = ", ".join(str(row[c]) for c in order if c not in ("kind", "detail") and row[c] not in (None, ""))
        raise OF_KIND[row.kind](f"{row.kind}: {row.detail} ({place})")
