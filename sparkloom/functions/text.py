"""Text functions as Column expressions; what no expression can say is a pandas UDF."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What name normalisation removes besides white space.
NAME_MARKS = "，,。．.、；;：:！!？?\"'「」『』【】（）()[]{}《》<>"
#: The same as a pattern. (?U) lets \s match every Unicode space.
NAME_PATTERN = "(?U)[\\s" + re.escape(NAME_MARKS) + "]"
#: What stands around a type name in lists.
TYPE_MARKS = r"[\d\s.\-*#]+"
#: Tags whose content is no text.
HTML_SKIPPED = ("script", "style", "nav", "footer", "header")


def normalize_name(name: Column) -> Column:
    """Without white space and punctuation, in lower case; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(name, F.lit("")), NAME_PATTERN, ""))


def strip(text: Column) -> Column:
    """Without white space at both ends, Unicode's spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def normalize_type_name(name: Column) -> Column:
    """A type name without list marks and doubled spaces; up to three lower-case words are capitalised; nothing left is Unknown."""
    bare = F.regexp_replace(F.regexp_replace(strip(F.coalesce(name, F.lit(""))), "(?U)^" + TYPE_MARKS, ""), "(?U)" + TYPE_MARKS + "$", "")
    bare = strip(F.regexp_replace(bare, r"(?U)\s+", " "))
    words = F.split(bare, " ")
    title = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")
    shown = F.when((bare == F.lower(bare)) & (F.size(words) <= 3), title).otherwise(bare)
    return F.when(shown == "", F.lit("Unknown")).otherwise(shown)


def window_chunks(text: Column, size: int, step: int) -> Column:
    """Windows of ``size`` characters every ``step`` over the whole text, as structs (chunk_idx, start, text); a text that fits is one chunk."""
    starts = F.when(F.length(text) <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.length(text) - 1, F.lit(step)))
    return F.transform(starts, lambda s, i: F.struct(i.alias("chunk_idx"), s.alias("start"), F.substr(text, s + 1, F.lit(size)).alias("text")))


def token_estimate(text: Column) -> Column:
    """About four characters to a token."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def segments(text: Column, pattern: str, most: int = 50, group: int = 0) -> Column:
    """The first matches of a pattern, over lines and with dots that match line ends."""
    return F.slice(F.regexp_extract_all(text, F.lit("(?ms)" + pattern), F.lit(group)), 1, most)


def occurrences(text: Column, query: str, context: int = 100, most: int = 10) -> Column:
    """Non-overlapping places of a plain string, as structs (position from 0, context). A query that is empty has none."""
    if not query:
        return F.array().cast("array<struct<position:int,context:string>>")
    pieces = F.transform(F.split(text, re.escape(query)), lambda p: F.length(p))
    # Of n + 1 pieces all but the last end where a match begins.
    n = F.least(F.size(pieces) - 1, F.lit(most))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    places = F.aggregate(F.slice(pieces, 1, n), start, lambda a, x: F.struct((a["at"] + x + len(query)).alias("at"), F.concat(a["out"], F.array(a["at"] + x)).alias("out")), lambda a: a["out"])
    first = lambda p: F.greatest(p - context, F.lit(0))
    return F.transform(places, lambda p: F.struct(p.alias("position"), F.substr(text, first(p) + 1, p + len(query) + context - first(p)).alias("context")))


def unfenced(text: Column) -> Column:
    """JSON text without a code fence around it."""
    bare = F.trim(text)
    return F.when(F.startswith(bare, F.lit("```")), F.regexp_replace(F.regexp_replace(bare, r"^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(bare)


def json_ladder(text: Column) -> Column:
    """The first of these that is valid JSON, as text: the whole, a fenced block, from the first brace to the last, from the first bracket to the last; else null."""

    def valid(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull() & (F.length(F.trim(c)) > 0), c)

    between = lambda a, b: F.when((F.locate(a, text) > 0), F.regexp_extract(text, rf"(?s)(\{a}.*\{b})", 1))
    return F.coalesce(valid(text), valid(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)), valid(between("{", "}")), valid(between("[", "]")))


def llm_entities(text: Column) -> Column:
    """The entities of a model's answer: type also as entity_type, missing confidence is 1."""
    raw = F.from_json(json_ladder(text), "entities array<struct<name:string,type:string,entity_type:string,mention:string,description:string,confidence:double,attributes:map<string,string>>>")
    some = F.coalesce(raw["entities"], F.array().cast("array<struct<name:string,type:string,entity_type:string,mention:string,description:string,confidence:double,attributes:map<string,string>>>"))
    return F.filter(F.transform(some, lambda e: F.struct(strip(F.coalesce(e["name"], F.lit(""))).alias("name"), F.coalesce(e["type"], e["entity_type"], F.lit("")).alias("type"), e["mention"].alias("mention"), F.coalesce(e["description"], F.lit("")).alias("description"), F.coalesce(e["confidence"], F.lit(1.0)).alias("confidence"), e["attributes"].alias("attributes"))), lambda e: e["name"] != "")


def llm_relations(text: Column) -> Column:
    """The relations of a model's answer: predicate also as relation."""
    raw = F.from_json(json_ladder(text), "relations array<struct<subject:string,predicate:string,relation:string,object:string,confidence:double,evidence:string>>")
    some = F.coalesce(raw["relations"], F.array().cast("array<struct<subject:string,predicate:string,relation:string,object:string,confidence:double,evidence:string>>"))
    return F.filter(F.transform(some, lambda r: F.struct(strip(F.coalesce(r["subject"], F.lit(""))).alias("subject"), F.coalesce(r["predicate"], r["relation"], F.lit("")).alias("predicate"), strip(F.coalesce(r["object"], F.lit(""))).alias("object"), F.coalesce(r["confidence"], F.lit(1.0)).alias("confidence"), r["evidence"].alias("evidence"))), lambda r: (r["subject"] != "") & (r["predicate"] != "") & (r["object"] != ""))


def noun_matches(text: Column) -> Column:
    """Candidate nouns without a language model: capitalised phrases, then lower-case words of three letters or more. Ends of words and white space are those of Unicode, as in Python's re."""
    whole = lambda p: F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_])({p})(?![\p{{L}}\p{{N}}_])"), F.lit(1))
    space = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    return F.concat(whole(f"[A-Z][a-z]+(?:{space}+[A-Z][a-z]+)*"), whole("[a-z]{3,}"))


def trigrams(text: Column) -> Column:
    """The distinct trigrams of the lower-case text with two spaces at either end."""
    padded = F.concat(F.lit("  "), F.lower(text), F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of trigrams."""
    shared = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(shared.cast("double"), (F.size(a) + F.size(b) - shared)), F.lit(0.0))


def similar_by_trigrams(names: DataFrame, col: str) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of distinct names that share a trigram, by joins on trigrams; any other pair's similarity is 0."""
    g = names.filter(F.col(col).isNotNull()).select(F.col(col).alias("name")).distinct().withColumn("g", trigrams(F.col("name")))
    each = g.select("name", F.size("g").alias("n"), F.explode("g").alias("gram"))
    a, b = each.select(F.col("name").alias("a"), F.col("n").alias("na"), "gram"), each.select(F.col("name").alias("b"), F.col("n").alias("nb"), "gram")
    shared = a.join(b, "gram").filter(F.col("a") < F.col("b")).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("a", "b", (F.col("shared").cast("double") / (F.col("na") + F.col("nb") - F.col("shared"))).alias("similarity"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.skip = [], []

    def handle_starttag(self, tag, attrs):
        if tag in HTML_SKIPPED:
            self.skip.append(tag)

    def handle_endtag(self, tag):
        if tag in self.skip:
            while self.skip.pop() != tag:
                pass

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def html_to_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Text()
    p.feed(html)
    p.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(p.parts)).strip()


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """The text of HTML without scripts, styles and page furniture."""
    return html.map(html_to_text)


def chunk_text(text: str, size: int = 4000, overlap: int = 300, most: int = 200) -> list[str]:
    """A text as chunks at paragraph and sentence ends; each but the first begins with the end of the one before.

    A text of one line is cut into windows, as many as it takes, so none of it is lost. Paragraphs longer than a
    chunk are cut at sentence ends. More chunks of paragraphs than ``most`` are joined, the pair of neighbours with the smallest sum first.
    """
    size, overlap = max(size, 1000), max(overlap, 100)
    if "\n" not in text.strip("\n"):
        if len(text) <= size:
            return [text]
        return [text[i : i + size] for i in range(0, len(text), size - overlap)]
    pieces: list[str] = []
    for para in filter(None, map(str.strip, re.split(r"\n\s*\n", text))):
        pieces += [para] if len(para) <= size else [s.strip() for s in _packed(re.split(r"(?<=[。！？.!?])\s*", para), size)]
    chunks = []
    held = ""
    for piece in filter(None, pieces):
        if held and len(held) + len(piece) > size:
            chunks.append(held.strip())
            held = held[-overlap:] + "\n\n" + piece
        else:
            held = f"{held}\n\n{piece}" if held else piece
    if held.strip():
        chunks.append(held.strip())
    while len(chunks) > most:
        i = min(range(len(chunks) - 1), key=lambda k: len(chunks[k]) + len(chunks[k + 1]))
        chunks[i : i + 2] = ["\n\n".join(chunks[i : i + 2])]
    return chunks or [text]


def _packed(sentences: list[str], size: int):
    held = ""
    for s in sentences:
        if held and len(held) + len(s) > size:
            yield held
            held = s
        else:
            held += s
    if held.strip():
        yield held


def paragraph_chunks(size: int = 4000, overlap: int = 300, most: int = 200):
    """A pandas UDF that cuts texts with chunk_text."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda x: chunk_text(x or "", size, overlap, most))

    return cut
