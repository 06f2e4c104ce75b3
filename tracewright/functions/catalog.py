"""Fixed values of the provenance data model: record kinds, keywords, formal attributes, datatypes."""

from __future__ import annotations

PROV = "http://www.w3.org/ns/prov#"
XSD = "http://www.w3.org/2001/XMLSchema#"
XSI = "http://www.w3.org/2001/XMLSchema-instance"

# Fixed values of the data model: kind -> (keyword of the textual notation, formal attributes in order).
KINDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "Entity": ("entity", ()),
    "Activity": ("activity", ("startTime", "endTime")),
    "Agent": ("agent", ()),
    "Generation": ("wasGeneratedBy", ("entity", "activity", "time")),
    "Usage": ("used", ("activity", "entity", "time")),
    "Communication": ("wasInformedBy", ("informed", "informant")),
    "Start": ("wasStartedBy", ("activity", "trigger", "starter", "time")),
    "End": ("wasEndedBy", ("activity", "trigger", "ender", "time")),
    "Invalidation": ("wasInvalidatedBy", ("entity", "activity", "time")),
    "Derivation": ("wasDerivedFrom", ("generatedEntity", "usedEntity", "activity", "generation", "usage")),
    "Attribution": ("wasAttributedTo", ("entity", "agent")),
    "Association": ("wasAssociatedWith", ("activity", "agent", "plan")),
    "Delegation": ("actedOnBehalfOf", ("delegate", "responsible", "activity")),
    "Influence": ("wasInfluencedBy", ("influencee", "influencer")),
    "Specialization": ("specializationOf", ("specificEntity", "generalEntity")),
    "Alternate": ("alternateOf", ("alternate1", "alternate2")),
    "Mention": ("mentionOf", ("specificEntity", "generalEntity", "bundle")),
    "Membership": ("hadMember", ("collection", "entity")),
}

TIMES = ("time", "startTime", "endTime")
ELEMENTS = ("Entity", "Activity", "Agent")
RELATIONS = tuple(k for k in KINDS if k not in ELEMENTS)
KEYWORD = {k: word for k, (word, _) in KINDS.items()}
KIND_OF_KEYWORD = {word: k for k, word in KEYWORD.items()}

# Subtypes with a keyword of their own -> (keyword, kind).
SUBTYPES: dict[str, tuple[str, str]] = {
    "Revision": ("wasRevisionOf", "Derivation"),
    "Quotation": ("wasQuotedFrom", "Derivation"),
    "PrimarySource": ("hadPrimarySource", "Derivation"),
    "SoftwareAgent": ("softwareAgent", "Agent"),
    "Person": ("person", "Agent"),
    "Organization": ("organization", "Agent"),
    "Plan": ("plan", "Entity"),
    "Collection": ("collection", "Entity"),
    "EmptyCollection": ("emptyCollection", "Entity"),
}
BASE_KIND = {k: k for k in KINDS} | {s: k for s, (_, k) in SUBTYPES.items()} | {"Bundle": "Entity"}

# Kinds that share no identifier with an element (constraint 54), and of those the kinds
# that share none with each other (constraint 53).
IDENTIFIED = ("Generation", "Usage", "Communication", "Start", "End", "Invalidation", "Derivation", "Attribution", "Association", "Delegation", "Influence")
DISJOINT = tuple(k for k in IDENTIFIED if k not in ("Derivation", "Influence"))

# The kind of an undeclared element in the role of a formal attribute; other roles give none.
ROLE_KIND = {
    "entity": "Entity", "activity": "Activity", "agent": "Agent", "trigger": "Entity", "generatedEntity": "Entity", "usedEntity": "Entity",
    "delegate": "Agent", "responsible": "Agent", "specificEntity": "Entity", "generalEntity": "Entity", "alternate1": "Entity", "alternate2": "Entity",
    "collection": "Entity", "informed": "Activity", "informant": "Activity", "bundle": "Bundle", "plan": "Entity", "ender": "Entity", "starter": "Entity",
}

# Attributes that any element may have, in the order of the XML notation.
COMMON = ("label", "location", "role", "type", "value")


def argument_names(kind: str) -> tuple[str, ...]:
    """Formal attributes that name things, in order: those of columns arg1 to arg5."""
    return tuple(a for a in KINDS[kind][1] if a not in TIMES)


def time_names(kind: str) -> tuple[str, ...]:
    """Formal attributes that are times, in order: those of columns t1 and t2."""
    return tuple(a for a in KINDS[kind][1] if a in TIMES)
