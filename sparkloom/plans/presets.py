"""Presets: named schemas, built in or read from a dataset's own list of relations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.ontology import EntityType, Ontology, RelationType, top_relations


@dataclass(frozen=True)
class Preset:
    """A schema by name. ``read`` gives its relation types from a file of the dataset; presets with fixed ones have none."""

    name: str
    display_name: str
    language: str = "en"
    description: str = ""
    entity_types: tuple[EntityType, ...] = ()
    relation_types: tuple[RelationType, ...] = ()
    entity_naming: str = "as_in_text"
    read: Callable[[SparkSession, str], tuple[RelationType, ...]] | None = None


_presets: dict[str, Preset] = {}


def register(preset: Preset) -> Preset:
    _presets[preset.name] = preset
    return preset


def get_preset(name: str) -> Preset | None:
    return _presets.get(name)


def list_presets() -> list[str]:
    return sorted(_presets)


def build_ontology(name: str, spark: SparkSession | None = None, path: str | None = None) -> Ontology | None:
    """The schema of a preset, with the relation types of its file where one is given; None for an unknown name."""
    p = _presets.get(name)
    if p is None:
        return None
    relations = p.read(spark, path) if p.read and path else p.relation_types
    return Ontology(p.name, p.description, p.entity_types, relations)


def _between_entities(rows) -> tuple[RelationType, ...]:
    return tuple(RelationType(name, said, "Entity", "Entity") for name, said in rows)


def from_predicates(predicates: DataFrame, name: str, most: int = 200) -> Ontology:
    """A schema of the most frequent predicates (predicate), between things of any kind. Only ``most`` rows reach the driver."""
    rows = top_relations(predicates, most).orderBy("predicate").collect()
    return Ontology(name, relation_types=_between_entities((r["predicate"], f"{name.upper()}: {r['predicate']} (appears {r['n']} times, {r['share'] * 100:.1f}%)") for r in rows))


def nested_predicates(jsonl: DataFrame) -> DataFrame:
    """(predicate) of JSON lines (value) whose relations name their predicate by its surface form."""
    parsed = jsonl.select(F.from_json("value", "relations array<struct<predicate:struct<surfaceform:string>>>").alias("x"))
    return parsed.select(F.explode("x.relations").alias("r")).select(F.col("r.predicate.surfaceform").alias("predicate")).filter("predicate <> ''")


def described(spark: SparkSession, path: str) -> tuple[RelationType, ...]:
    """Relation types of a CSV file without a header: name, description."""
    rows = spark.read.csv(path, schema="name string, said string", multiLine=True, escape='"').select(F.trim("name"), F.trim("said")).collect()
    return _between_entities((n, s) for n, s in rows if n and s)


def numbered(spark: SparkSession, path: str) -> list[str]:
    """The names of a relation index, a JSON list whose last item maps names to numbers, sorted."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("x")).select(F.from_json(F.element_at("x", -1), "map<string,int>").alias("m"))
    return sorted(raw.select(F.explode(F.map_keys("m"))).toPandas().iloc[:, 0])


def freebase(spark: SparkSession, path: str) -> tuple[RelationType, ...]:
    return _between_entities((n, f"NYT: {n.rsplit('/', 1)[-1]} ({n})") for n in numbered(spark, path))


def plain(spark: SparkSession, path: str) -> tuple[RelationType, ...]:
    return _between_entities((n, f"Relation: {n}") for n in numbered(spark, path))


def surface_forms(spark: SparkSession, path: str) -> tuple[RelationType, ...]:
    return from_predicates(nested_predicates(spark.read.text(path)), "sredfm").relation_types


ANYTHING = (EntityType("Entity", "Any entity"),)
NAMED = (EntityType("Entity", "Any named entity, concept, location, person, organization, number, or date"),)

#: The entity types of a corpus of Korean cultural heritage.
HERITAGE_TYPES = {
    "ARTIFACTS": "Artifact: building, craft, documents, historical sites, monument, musical instrument, pagoda, painting, relic, weapon, etc.",
    "PERSON": "Person: mythical figure, name, noun, position",
    "TERM": "Term: color, mark, shape, technique",
    "DATE": "Date: day, duration, dynasty, geo-age, month, season, year",
    "POLITICAL_LOCATION": "Political location: capital city, city, country, county, province",
    "CIVILIZATION": "Civilization: building type, clothing, currency, drink, food, language, law, policy, sports, tribe",
    "MATERIAL": "Material: bone, fiber, grass, jewelry, metal, paper, rock, rubber, soil, wood, etc.",
    "LOCATION": "Location: space, others",
    "ANIMAL": "Animal: amphibian, bird, fish, insect, mammal, reptile, type",
    "PLANT": "Plant: flower, fruit, grass, tree, type",
    "GEOGRAPHICAL_LOCATION": "Geographical: bay, continent, island, mountain, ocean, river",
    "EVENT": "Event: activity, festival, sports, war/revolution",
}
#: Its relations, each with what a subject does to an object.
HERITAGE_RELATIONS = {
    "OriginatedIn": "originated in / from the object (origin/location provenance)",
    "consistsOf": "consists of the object (composition/part-whole)",
    "depicts": "depicts the object (representation)",
    "documents": "documents the object (documentation)",
    "fallsWithin": "falls within the object (spatial/temporal containment)",
    "hasCarriedOut": "has carried out the object (performer/agent of action)",
    "hasCreated": "has created the object (creation authorship)",
    "hasDestroyed": "has destroyed the object (destruction)",
    "hasSection": "has the object as a section (partitive)",
    "hasTime": "has the object as its time (temporal association)",
    "isConnectedWith": "is connected with the object (association/connection)",
    "isUsedIn": "is used in the object (instrumental usage)",
    "servedAs": "served as the object (function/role)",
    "wears": "wears the object (attire/adornment)",
}
#: The entity types of a multilingual corpus of encyclopedia relations.
WIKI_TYPES = {
    "Concept": "Abstract concept (taxon, species, etc.)",
    "LOC": "Geographic location",
    "DATE": "Date or time value",
    "NUMBER": "Numeric value",
    "PER": "Person",
    "ORG": "Organization or institution",
    "MEDIA": "Media work (film, book, album, etc.)",
    "EVE": "Event",
    "MISC": "Miscellaneous entity",
    "CEL": "Celestial body",
    "TIME": "Time duration or interval",
    "DIS": "Disease or medical condition",
    "UNK": "Unknown entity type",
}

register(Preset("kochet", "KoCHET (Korean Cultural Heritage, 14 relations)", "ko", "Relations of historical documents in Korean", tuple(EntityType(*t) for t in HERITAGE_TYPES.items()), _between_entities((n, f"A {n} B — The subject {said}") for n, said in HERITAGE_RELATIONS.items())))
register(Preset("sredfm", "SREDFM (Multilingual RE, Wikidata properties)", "en", "Relations in 15 languages by the surface forms of their properties", tuple(EntityType(*t) for t in WIKI_TYPES.items()), read=surface_forms))
webnlg = register(Preset("webnlg", "WebNLG (DBpedia, 159 relations)", "en", "Sentences of 16 categories of DBpedia", NAMED, entity_naming="underscore", read=described))
nyt = register(Preset("nyt", "NYT (24 Freebase relations)", "en", "News sentences with relations of Freebase", ANYTHING, read=freebase))
register(replace(nyt, name="nyt_star", display_name="NYT-star (24 Freebase relations)"))
register(replace(webnlg, name="webnlg_repo", display_name="WebNLG-repo (216 DBpedia relations)", entity_types=ANYTHING, read=plain))
register(replace(webnlg, name="webnlg_star", display_name="WebNLG-star (171 DBpedia relations)", entity_types=ANYTHING, read=plain))
register(Preset("rebel", "REBEL (Wikidata, 196 relations)", "en", "Encyclopedia abstracts with relations of Wikidata", NAMED, read=described))
register(Preset("wiki_nre", "Wiki-NRE (Wikidata, 45 relations)", "en", "Encyclopedia sentences with relations of Wikidata", NAMED, read=described))
