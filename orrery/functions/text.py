"""Text rules of questions, answers and status words as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Question families in order, each with the patterns by which it is told, whatever the case.
FAMILIES = (
    ("exist", (r"^(Are|Is) there", r"^(Are|Is) any", r"^(Do|Does) .+ exist", r"^Can you see")),
    ("count", (r"^How many", r"^What number of", r"^What is the number of")),
    ("status", (r"^What (is|are) the status", r"^What status (is|are)", r"what (is|are) .+ status")),
    ("object", (r"^What (is|are) the .+ thing", r"^What (is|are) .+ that", r"^The .+ (is|are) what", r". is what\?$", r"^There is .+what is it\??$", r"what is it\??$")),
    ("comparison", (r"same (status|type) as", r"same as", r"(is|are) .+ the same")),
)
#: Synonyms that questions are freed of, in this order; those of directions are replaced inside words too.
WORD_SYNONYMS = (
    ("construction vehicle", "truck"), ("construction vehicles", "trucks"), ("vehicle", "car"), ("vehicles", "cars"),
    ("stationary", "stopped"), ("not moving", "stopped"), ("driving", "moving"), ("running", "moving"),
)
PHRASE_SYNONYMS = (
    ("in front of", "to the front of"), ("in the front of", "to the front of"), ("behind", "to the back of"), ("in the back of", "to the back of"),
    ("to the rear of", "to the back of"), ("on the left of", "to the left of"), ("on the right of", "to the right of"),
)
#: Names of types as asked, by the name that they stand for.
TYPE_NAMES = {
    "cars": "car", "traffic cones": "traffic cone", "pedestrians": "pedestrian", "buss": "bus", "busses": "bus", "buses": "bus", "trucks": "truck", "bicycles": "bicycle", "motorcycles": "motorcycle",
    "barriers": "barrier", "trailers": "trailer", "construction vehicles": "construction vehicle",
}
#: What the tokenizer of questions drops.
DROPPED = r"[.,'!?\"()*#:;]"


def squeeze(text: Column) -> Column:
    """Trimmed, with single spaces."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def replaced(text: Column, synonyms: list[tuple[str, str]]) -> Column:
    """Whole-word replacements, one after the other, whatever the case."""
    return reduce(lambda t, s: F.regexp_replace(t, rf"(?i)\b{s[0]}\b", s[1]), synonyms, text)


def normalised_question(text: Column) -> Column:
    """Single spaces, and synonyms replaced by one wording each."""
    words = replaced(squeeze(text), list(WORD_SYNONYMS))
    return reduce(lambda t, s: F.regexp_replace(t, rf"(?i){s[0]}", s[1]), PHRASE_SYNONYMS, words)


def question_family(text: Column) -> Column:
    """The first family of which a pattern fits the text, else general. The text is computed once, as the variable of a transform, not once for each pattern."""
    fits = lambda t, patterns: reduce(lambda a, b: a | b, [t.rlike(f"(?i){p}") for p in patterns])
    told = lambda t: reduce(lambda acc, f: F.when(fits(t, f[1]), F.lit(f[0])).otherwise(acc), reversed(FAMILIES), F.lit("general"))
    return F.get(F.transform(F.array(text), told), F.lit(0))


#: Words that a question's pattern leaves open, by kind; longer ones are replaced first.
OPEN_WORDS = {
    "TYPE": ("car", "cars", "pedestrian", "pedestrians", "bicycle", "bicycles", "motorcycle", "motorcycles", "truck", "trucks", "bus", "buses", "trailer", "trailers", "barrier", "barriers", "traffic cone", "traffic cones", "construction vehicle", "construction vehicles", "thing", "things"),
    "STATUS": ("moving", "stopped", "parked", "standing", "sitting", "not standing", "with rider", "without rider"),
    "DIR": ("front left", "front right", "back left", "back right", "front", "back", "left", "right"),
}


def question_pattern(text: Column) -> Column:
    """The text with {TYPE}, {STATUS} and {DIR} for the words of these kinds, wherever they stand."""
    words = [(w, f"{{{kind}}}") for kind, own in OPEN_WORDS.items() for w in sorted(own, key=len, reverse=True)]
    return reduce(lambda t, w: F.replace(t, F.lit(w[0]), F.lit(w[1])), words, text)


def question_leaf(family: Column, pattern: Column) -> Column:
    """One of the 24 leaves of the taxonomy of questions (fixed names): family, and how its pattern asks (by same status, near the own vehicle, near an object, globally)."""
    p = F.lower(pattern)
    has = lambda x: F.contains(p, F.lit(x))
    times = F.size(F.split(p, r"to the \{dir\} of")) - 1
    own, near = has("to the {dir} of me"), has("to the {dir} of")

    def listed(name: str) -> Column:
        same = F.when(has("to the {dir}"), f"{name}_same_status_directional").otherwise(f"{name}_same_status_global")
        rest = F.when(has("{status}") & has("{type}"), f"{name}_status_type_global").when(has("{type}"), f"{name}_type_global").otherwise(f"{name}_other")
        return F.when(has("same status"), same).when(own, f"{name}_type_near_ego").when(near, f"{name}_type_near_obj").otherwise(rest)

    asked = {
        "exist": listed("exist"), "count": listed("count"),
        "status": F.when(own, "status_of_obj_near_ego").when(near, "status_of_obj_near_obj").otherwise("status_of_obj_global"),
        "object": F.when(has("both to the") | (times >= 2), "object_multi_constraint").when(own, "object_near_ego").when(near, "object_near_obj").otherwise("object_global"),
        "comparison": F.when(times >= 2, "comparison_both_directional").when(near, "comparison_one_directional").otherwise("comparison_global"),
    }
    return reduce(lambda acc, f: F.when(family == f[0], f[1]).otherwise(acc), asked.items(), F.concat(family, F.lit("_other")))


def tokens(text: Column) -> Column:
    """Lower-case words without punctuation; - and / separate."""
    flat = F.regexp_replace(F.regexp_replace(F.lower(text), DROPPED, ""), "[-/]", " ")
    return F.array_remove(F.split(flat, r"\s+"), "")


def padded(ids: Column, length: int = 30, pad: int = 0) -> Column:
    """Exactly ``length`` ids."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), length)), 1, length)


def short_category(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def inferred_status(attribute: Column, speed: Column) -> Column:
    """By attribute words in a fixed order (parked counts as stopped), else stopped below half a metre a second."""
    has = lambda w: attribute.contains(w)
    return (
        F.when(has("without_rider"), "without_rider").when(has("with_rider"), "with_rider")
        .when(has("stopped") | has("parked"), "stopped").when(has("standing"), "standing").when(has("sitting"), "sitting")
        .when(has("moving"), "moving").when(speed < 0.5, "stopped").otherwise("moving")
    )


def status_matches(status: Column, asked: Column, kind: Column) -> Column:
    """Equality after folding _ and spaces; "not standing" are pedestrians of any other status."""
    fold = lambda c: F.replace(F.lower(c), F.lit("_"), F.lit(" "))
    return F.when(fold(asked) == "not standing", (kind == "pedestrian") & (fold(status) != "standing")).otherwise(fold(status) == fold(asked))


def loosely_same_status(status: Column, asked: Column) -> Column:
    """Equality of statuses where parked counts as stopped and moving as not standing; an unknown status fits nothing."""
    fold = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))
    name = lambda c: F.when(fold(c) == "parked", "stopped").when(fold(c) == "moving", "not standing").otherwise(fold(c))
    return F.coalesce((name(status) == name(asked)) & ~fold(status).isin("", "unknown"), F.lit(False))


def vehicle_matches(category: Column, asked: Column) -> Column:
    """Whether a category is of the asked type: trailers by the word anywhere in it, trucks without trailers, other types by their name."""
    low = F.lower(category)
    return F.when(asked == "trailer", F.contains(low, F.lit("trailer"))).when(asked == "truck", F.contains(low, F.lit("truck")) & ~F.contains(low, F.lit("trailer"))).otherwise(F.contains(low, F.lower(asked)))


def same_answer(a: Column, b: Column) -> Column:
    """Equality of answers: case, _ and spaces, and parked or stopped make no difference."""
    fold = lambda c: F.regexp_replace(F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" ")), r"^parked$", "stopped")
    return fold(a) == fold(b)


def type_matches(kind: Column, asked: Column) -> Column:
    """Whether the type holds the asked name, after folding _ and plurals; things and objects are anything but ego."""
    fold = lambda c: F.replace(F.lower(F.trim(c)), F.lit("_"), F.lit(" "))
    name = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[fold(asked)], fold(asked))
    return (
        F.when(name.isin("thing", "things", "object", "objects"), fold(kind) != "ego")
        .when(name == "traffic cone", fold(kind).contains("traffic cone") | fold(kind).contains("trafficcone"))
        .when(name == "construction vehicle", fold(kind).contains("construction")).otherwise(fold(kind).contains(name))
    )


def json_list(text: Column) -> Column:
    """array<string> of a JSON list; anything else is the empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def any_timestamp(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy/MM/dd HH:mm:ss")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def fingerprint16(*columns: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the columns as JSON."""
    return F.substring(F.sha1(F.to_json(F.struct(*columns))), 1, 16)


def difficulty(candidates: Column, constraints: Column, external: Column) -> Column:
    return candidates * F.greatest(constraints, F.lit(1)) + 2 * external


#: Full category names by the detection class that they count for, and the classes that are tracked.
DETECTION_CLASSES = {
    "movable_object.barrier": "barrier", "vehicle.bicycle": "bicycle", "vehicle.bus.bendy": "bus", "vehicle.bus.rigid": "bus", "vehicle.car": "car", "vehicle.construction": "construction_vehicle",
    "vehicle.motorcycle": "motorcycle", "human.pedestrian.adult": "pedestrian", "human.pedestrian.child": "pedestrian", "human.pedestrian.construction_worker": "pedestrian",
    "human.pedestrian.police_officer": "pedestrian", "movable_object.trafficcone": "traffic_cone", "vehicle.trailer": "trailer", "vehicle.truck": "truck",
}
TRACKED = ("bicycle", "bus", "car", "motorcycle", "pedestrian", "trailer", "truck")
#: Types and statuses that an answer may name, in the order in which they are looked for.
ANSWER_TYPES = ("car", "truck", "bus", "bicycle", "pedestrian", "ego", "barrier", "motorcycle", "trailer")
ANSWER_STATUSES = (("stopped", ("stopped", "stationary", "not moving")), ("parked", ("parked",)), ("moving", ("moving", "driving", "running")), ("with rider", ("with rider", "with_rider")), ("without rider", ("without rider", "without_rider")), ("standing", ("standing",)))


def detection_class(category: Column) -> Column:
    """The detection class of a category, null for others."""
    return F.create_map(*[F.lit(x) for kv in DETECTION_CLASSES.items() for x in kv])[category]


def tracking_class(category: Column) -> Column:
    """The tracking class of a category, null where none is tracked."""
    kind = detection_class(category)
    return F.when(kind.isin(*TRACKED), kind)


def formatted_answer(family: Column, text: Column) -> Column:
    """The bare answer inside a free text, by the question's family: yes or no, the first number, a status, a type, else the trimmed text."""
    low = F.lower(text)
    has = lambda *words: reduce(lambda a, b: a | b, [low.contains(w) for w in words])
    yes_no = F.when(has("yes", "visible", "found"), "yes").otherwise("no")
    number = F.coalesce(F.nullif(F.regexp_extract(text, r"\b(\d+)\b", 1), F.lit("")), F.lit("0"))
    status = reduce(lambda acc, s: F.when(has(*s[1]), F.lit(s[0])).otherwise(acc), reversed(ANSWER_STATUSES), F.trim(text))
    kind = reduce(lambda acc, t: F.when(has(t), F.lit(t)).otherwise(acc), reversed(ANSWER_TYPES), F.trim(text))
    return F.when(family.isin("exist", "comparison"), yes_no).when(family == "count", number).when(family == "status", status).when(family == "object", kind).otherwise(F.trim(text))


def plural(noun: Column) -> Column:
    """English plural of a type: es after s, x and ch, ies for y after a consonant."""
    return F.when(noun.rlike("(s|x|ch)$"), F.concat(noun, F.lit("es"))).when(noun.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(noun, "y$", ""), F.lit("ies"))).otherwise(F.concat(noun, F.lit("s")))


def with_article(noun: Column) -> Column:
    return F.concat(F.when(noun.rlike("(?i)^[aeiou]"), F.lit("an ")).otherwise(F.lit("a ")), noun)


def first_object(text: Column) -> Column:
    """The first {...} without inner braces, null without one."""
    return F.nullif(F.regexp_extract(text, r"(\{[^{}]*\})", 1), F.lit(""))


def canonical_name(name: Column) -> Column:
    """A column name in lower case with single underscores."""
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
