"""Query templates: the SPARQL text that answers one kind of question about one person or school."""

from __future__ import annotations

from lorewright.operators.sparql import quoted

#: Single attributes by template.
ATTRIBUTES = {
    "ask_style_name": "styleName",
    "ask_hao": "hao",
    "ask_birth": "birthYear",
    "ask_death": "deathYear",
    "ask_native_place": "nativePlace",
    "ask_dynasty": "dynasty",
    "ask_biography": "biography",
    "ask_masterpiece": "masterpiece",
}
# The predicates that count as relations, by template.
RELATIONS = ("hasTeacher", "hasStudent", "hasFriend", "hasFather", "hasSon", "hasFounder", "influencedBy", "inheritedFrom")
DIRECT = ("hasTeacher", "hasStudent", "hasFriend", "hasFather", "hasSon")
NOT_GENERAL = ("personName", "confidence", "dataSource", "extractionMethod", "ctextId", "cbdbId")
TWO_PERSONS = ("hasTeacher", "hasStudent", "hasFriend")


def _list(names: tuple[str, ...]) -> str:
    return ", ".join(f"ex:{n}" for n in names)


def template(kind: str, name: str, other: str | None = None) -> str:
    """The text of template *kind* for *name* (and *other*, for two_person_relation)."""
    n = quoted(name)
    if kind in ATTRIBUTES:
        a = ATTRIBUTES[kind]
        return f"SELECT ?{a} WHERE {{ ?person ex:personName {n} . ?person ex:{a} ?{a} }}"
    if kind in ("ask_teacher", "ask_student"):
        who, out, back = ("teacher", "hasTeacher", "hasStudent") if kind == "ask_teacher" else ("student", "hasStudent", "hasTeacher")
        return (
            f"SELECT ?{who}Name ?rel WHERE {{ ?person ex:personName {n} ."
            f' {{ ?person ex:{out} ?x . BIND("{out}" AS ?rel) }} UNION {{ ?x ex:{back} ?person . BIND("{back}" AS ?rel) }}'
            f" ?x ex:personName ?{who}Name }}"
        )
    if kind == "ask_friend":
        return f"SELECT DISTINCT ?friendName WHERE {{ ?person ex:personName {n} . {{ ?person ex:hasFriend ?x }} UNION {{ ?x ex:hasFriend ?person }} ?x ex:personName ?friendName . FILTER(?friendName != {n}) }}"
    if kind == "ask_school":
        return f"SELECT DISTINCT ?schoolName WHERE {{ ?person ex:personName {n} . {{ ?person ex:belongsToSchool ?school }} UNION {{ ?person ex:hasFounder ?school }} ?school ex:schoolName ?schoolName }}"
    if kind == "ask_school_members":
        return f"SELECT DISTINCT ?personName WHERE {{ ?person ex:belongsToSchool ?school . ?school ex:schoolName {n} . ?person ex:personName ?personName }}"
    if kind == "ask_relation":
        leg = f"?person ex:personName {n} . {{0}} . ?target ex:personName ?targetName . FILTER(?rel IN ({_list(RELATIONS)}))"
        legs = (leg.format("?person ?rel ?target"), leg.format("?target ?rel ?person"))
        return f"SELECT ?rel ?targetName WHERE {{ {{ {legs[0]} }} UNION {{ {legs[1]} }} }}"
    if kind == "ask_path":
        return f"SELECT ?rel ?targetName WHERE {{ ?person ex:personName {n} . ?person ?rel ?target . ?target ex:personName ?targetName . FILTER(?rel IN ({_list(DIRECT)})) }}"
    if kind == "ask_founder":
        return f"SELECT ?founderName WHERE {{ ?school ex:schoolName ?schoolName . FILTER(CONTAINS(?schoolName, {n})) ?person ex:hasFounder ?school . ?person ex:personName ?founderName }}"
    if kind == "two_person_relation":
        legs = []
        for r in TWO_PERSONS:
            legs.append(f'{{ ?a ex:{r} ?b . BIND("{r}" AS ?rel) ?b ex:personName ?targetName }}')
        for r in TWO_PERSONS:
            legs.append(f'{{ ?b ex:{r} ?a . BIND("reverse:{r}" AS ?rel) ?a ex:personName ?targetName }}')
        return f"SELECT ?rel ?targetName WHERE {{ ?a ex:personName {n} . ?b ex:personName {quoted(other or '')} . {' UNION '.join(legs)} }}"
    return f"SELECT ?p ?o WHERE {{ ?person ex:personName {n} . ?person ?p ?o . FILTER(?p NOT IN ({_list(NOT_GENERAL)})) }}"
