"""State entities from the text of register filings, and that text from archives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierwalk.functions.names import names_in
from tierwalk.functions.text import let, stripped

_FIELD = r"(?id)(?:{})[:\s]*(.+?)(?:\n|$)"
# Labels of fields; officers' headings and how many characters after one are read.
LABELS = {
    "name": "Entity Name|Filing Name", "entity_type": "Entity Type|Type of Entity", "status": "Status", "formation_date": "Formation Date|Date of Formation|Date Filed", "registered_agent": "Registered Agent|Agent Name",
    "registered_agent_address": r"Registered (?:Office )?Address",
}
OFFICERS = r"(?id)(?:Officers?|Directors?|Managers?|Partners?|Members?)\s*(?:and\s*\w+\s*)?[:\n]"
OFFICERS_LENGTH = 2000


def officers(text: Column) -> Column:
    """Names after the first heading of officers."""
    section = F.left(F.coalesce(F.get(F.split(text, OFFICERS, 2), F.lit(1)), F.lit("")), F.lit(OFFICERS_LENGTH))
    return F.filter(names_in(section), lambda n: (F.length(n) > 4) & (F.length(n) < 60))


def entities(texts: DataFrame, state: str = "TX", text: str = "text") -> DataFrame:
    """State entities from texts (text, source_file): fields by their labels; without a labelled name the first line of more than five characters."""
    t = F.col(text)
    field = lambda n: stripped(F.regexp_extract(t, _FIELD.format(LABELS[n]), 1))
    line = F.get(F.filter(F.transform(F.split(t, "\n"), stripped), lambda x: F.length(x) > 5), F.lit(0))
    name = let(field("name"), lambda n: F.when(n != "", n).otherwise(F.coalesce(line, F.lit(""))))
    return texts.select(name.alias("name"), F.lit(state).alias("state"), *[field(f).alias(f) for f in LABELS if f != "name"], officers(t).alias("officers"), F.lit("").alias("jurisdiction_of_formation"), "source_file")


def texts(spark: SparkSession, path: str, extract) -> DataFrame:
    """source_file, text of documents, and of documents in archives, by `extract` (bytes to text, or None); any library for that is the caller's."""

    def run(frames):
        import io
        import zipfile

        import pandas as pd

        for f in frames:
            out = []
            for p, data in zip(f["path"], f["content"], strict=True):
                if p.lower().endswith(".zip"):
                    with zipfile.ZipFile(io.BytesIO(data)) as z:
                        parts = [(f"{p}!{n}", z.read(n)) for n in sorted(z.namelist()) if n.lower().endswith(".pdf")]
                else:
                    parts = [(p, data)]
                out += [(n, t) for n, d in parts if (t := extract(d))]
            yield pd.DataFrame(out, columns=["source_file", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "source_file string, text string")
