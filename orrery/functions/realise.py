"""Questions in words for plans over three objects: forms with several wordings, of which a seed picks one for each key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: name: (family, kind of answer, wordings). Open places: {label} what is asked for with its rank, {one} with an article, {many} in plural, {dir} and {dir2} directions,
#: {a} {b} {c} objects, {x} {y} descriptions of branches, {extra} further clauses.
FORMS: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "converge_object": ("converge", "object", ("Name the {label} that is to the {dir} of {a} and to the {dir2} of {c}{extra}.", "What is the {label} to the {dir} of {a} and to the {dir2} of {c}{extra}?")),
    "converge_status": ("converge", "status", ("In which status is the {label} to the {dir} of {a} and to the {dir2} of {c}{extra}?", "What is the status of the {label} to the {dir} of {a} and to the {dir2} of {c}{extra}?")),
    "converge_exist": ("converge", "boolean", ("Does {one} stand to the {dir} of {a} and to the {dir2} of {c}{extra}?", "Is any {label} to the {dir} of {a} and to the {dir2} of {c}{extra}?")),
    "converge_count": ("converge", "count", ("How many {many} stand to the {dir} of {a} and to the {dir2} of {c}{extra}?", "Give the number of {many} to the {dir} of {a} and to the {dir2} of {c}{extra}.")),
    "diverge_status": ("diverge_compare", "boolean", ("Does the status of {x} equal that of {y}?", "Have {x} and {y} one and the same status?")),
    "diverge_type": ("diverge_compare", "boolean", ("Is {x} of the type of {y}?", "Have {x} and {y} one and the same type?")),
    "branch_status": ("diverge_compare", "status", ("In which status is {x}?", "Tell the status of {x}.")),
    "branch_object": ("diverge_compare", "object", ("What is {x}?", "Name {x}.")),
    "branch_exist": ("diverge_compare", "boolean", ("Is {x} in view?", "Does {one} stand to the {dir} of {b}{extra}?")),
    "branch_count": ("diverge_compare", "count", ("How many {many} stand to the {dir} of {b}{extra}?", "Give the number of {many} to the {dir} of {b}{extra}.")),
    "counterfactual_exist": ("counterfactual_exist", "boolean", ("Does {one} stand to the {dir} of {b}?", "Is any {label} to the {dir} of {b}?", "Is {one} found to the {dir} of {b}?")),
    "distance_chain": ("distance_chain", "choice", ("Which of {a} and {c} has the shorter way to {b}?", "Is it {a} or {c} that {b} is nearer to?")),
    "direction_chain": ("direction_chain", "boolean", ("Going on from {b} in the direction from {a} to {b}, does one meet {c}?", "Is the direction from {b} to {c} that from {a} to {b}?")),
    "viewpoint": ("viewpoint_transfer", "choice", ("Looking from {a} to {b}, is {c} on the left or on the right?", "On which side, left or right, of the view from {a} to {b} is {c}?")),
}


def one(noun: Column) -> Column:
    return F.concat(F.when(noun.rlike("^[aeiouAEIOU]"), "an ").otherwise("a "), noun)


def many(noun: Column) -> Column:
    """Plural of a type; plurals stay, and no noun means objects."""
    return F.when(noun == "", "objects").when(noun.endswith("s"), noun).when(noun.rlike("[^aeiouAEIOU]y$"), F.concat(F.regexp_replace(noun, "y$", ""), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))


def rank_words(clauses: Column) -> Column:
    """The first rank (kind dist_rank) of ``clauses`` (kind, value, ref) as words before a noun, empty without one."""
    rank = F.get(F.filter(clauses, lambda c: c["kind"] == "dist_rank"), F.lit(0))["value"]
    return F.coalesce(F.concat(F.replace(rank, F.lit("-"), F.lit(" ")), F.lit(" ")), F.lit(""))


def extra_words(clauses: Column) -> Column:
    """All directions (kind ref_dir) of ``clauses`` as words after a description."""
    told = F.transform(F.filter(clauses, lambda c: c["kind"] == "ref_dir"), lambda c: F.concat(F.lit(", and to the "), F.replace(c["value"], F.lit("_"), F.lit(" ")), F.lit(" of "), c["ref"]))
    return F.array_join(told, "")


def label(kind: Column, clauses: Column) -> Column:
    return F.when(kind == "ego", "ego vehicle").otherwise(F.concat(rank_words(clauses), kind))


def description(kind: Column, direction: Column, anchor: Column, clauses: Column) -> Column:
    """An object by its type, its direction from an anchor and further clauses."""
    return F.concat(F.lit("the "), label(kind, clauses), F.lit(" to the "), F.replace(direction, F.lit("_"), F.lit(" ")), F.lit(" of "), anchor, extra_words(clauses))


def wording(form: str, key: Column, seed: int = 0) -> Column:
    """One of a form's wordings, by a hash of seed and key, so that a run can be repeated."""
    wordings = FORMS[form][2]
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 7), 16, 10).cast("bigint"), F.lit(len(wordings)))
    return F.element_at(F.array(*[F.lit(w) for w in wordings]), (pick + 1).cast("int"))


def realised(form: str, key: Column, seed: int = 0, **parts: Column) -> Column:
    """struct<question, answer_type, template_family> of a form, its open places filled by ``parts``."""
    told = wording(form, key, seed)
    for name, value in parts.items():
        told = F.replace(told, F.lit(f"{{{name}}}"), value)
    return F.struct(F.trim(F.regexp_replace(told, r"\s+", " ")).alias("question"), F.lit(FORMS[form][1]).alias("answer_type"), F.lit(FORMS[form][0]).alias("template_family"))
