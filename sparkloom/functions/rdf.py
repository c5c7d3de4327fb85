"""N-Triples: percent-encoded names, escaped literals, lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the output format.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
XSD_STRING = "http://www.w3.org/2001/XMLSchema#string"
NAME = "名称"


def uri(text: Column) -> Column:
    """Percent-encoded, all but letters, digits and _.-~"""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def literal(text: Column) -> Column:
    """With the five escapes of a quoted string."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD_STRING}>'))


def node(type_: Column, name: Column) -> Column:
    return F.concat(F.lit("<"), uri(type_), F.lit("/"), uri(name), F.lit(">"))


def statement(subject: Column, predicate: Column, object_: Column) -> Column:
    return F.concat_ws(" ", subject, F.concat(F.lit("<"), predicate, F.lit(">")), object_, F.lit("."))


def relation_line(subj_type: Column, subj_name: Column, predicate: Column, obj_type: Column, obj_name: Column) -> Column:
    return statement(node(subj_type, subj_name), uri(predicate), node(obj_type, obj_name))
