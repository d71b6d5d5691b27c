"""Facts of a document from its path, its file's properties and the lines of its first page."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as X

# Patterns of codes, years, cities, organisations and lines that are no title.
CODE = r"\b([А-ЯA-Z]{2,6}\.\d{3,6}\.\d{3,6}(\s*[А-ЯA-Z]{2,4})?(\s*v?\d+(\.\d+)?)?)\b"
YEAR = r"\b(19\d{2}|20\d{2})\b"
CITY = (
    "(Москва|Санкт-Петербург|Нижний Новгород|Екатеринбург|Новосибирск|Казань|Самара|Челябинск|Уфа|Ростов-на-Дону|Montreal|Paris|Casablanca|London|Berlin|New York)"
)
ORGANISATION = '(ООО|ЗАО|ОАО|ПАО|АО|НПФ|НПО|Предприятие|Завод|Компания|«[^»]+»|"[^"]+")'
ORGANISATION_NAME = r'(«[^»]+»|"[^"]+"|[А-ЯA-Z][а-яa-zА-ЯA-Z\s\-]{3,30})'
NO_TITLE = "^(untitled|содержание|оглавление|введение|документ|document|table of contents|microsoft word)"
NO_TITLE_LINE = r"^(ООО|ЗАО|ОАО|ПАО|АО|НПФ|НПО|тел|факс|www\.|http|e-mail|содержание|оглавление|введение|стр\.)"
SILOS = ["technical-docs", "hr-policies", "financial-reports", "legal-contracts", "product-catalog", "release-notes-tickets"]
# Words of each document type and level, the first that fits counts.
TYPES = {
    "Runbook": ["руководство по эксплуатации", "инструкция", "руководство пользователя", "manual"],
    "Specification": ["паспорт", "технические условия", "спецификация", "specification"],
    "Policy": ["политика", "регламент", "policy"],
    "Report": ["отчет", "report"],
}
LEVELS = {"Confidential": ["конфиденциально", "confidential"], "Restricted": ["для служебного пользования", "дсп", "restricted"]}
FIRST_YEAR = 1990


@dataclass(frozen=True)
class FactDefaults:
    silo: str = "technical-docs"
    department: str = "Engineering"
    office: str = "Central"
    confidentiality_level: str = "Public"
    document_type: str = "Specification"
    author: str = "Unknown"


def _found(lines: Column, pattern: str, flags: str = "(?iuU)", group: int = 0) -> Column:
    """What the pattern finds in each line that it is in, in the order of the lines."""
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, flags + pattern, group)), lambda x: x != "")


def _first(values: Column) -> Column:
    return F.get(values, 0)


def _named(text: Column, table: dict[str, list[str]], default: str) -> Column:
    out = F.lit(default)
    for name, phrases in reversed(table.items()):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | text.contains(p)
        out = F.when(hit, name).otherwise(out)
    return out


def document_facts(documents: DataFrame, now: str, defaults: FactDefaults | None = None) -> DataFrame:
    """``(document_id, id, silo, department, office, confidentiality_level, document_type, fiscal_year, author, last_modified, title)``.

    ``documents`` has (document_id, source_path, lines: array of the first page's, info_title,
    info_author, modified: date), everything but the id nullable. ``now`` (a date) stands in
    for an unknown modification; years later than it don't count. A path without any letter
    or digit gives an id made of the hash of document_id.
    """
    d = defaults or FactDefaults()
    lines = F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: x.isNotNull())
    path = F.coalesce("source_path", F.lit(""))
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")
    today = F.lit(now).cast("date")
    rows = documents.withColumns({"ls": lines, "file_name": name})
    rows = rows.withColumn("code", X.trim(F.coalesce(_first(_found(F.col("ls"), CODE)), F.nullif(F.regexp_extract("file_name", "(?iuU)" + CODE, 0), F.lit("")), F.lit(""))))
    raw = F.when(F.col("code") != "", F.col("code")).otherwise(F.col("file_name"))
    plain = F.regexp_replace(F.regexp_replace(raw, r"[^\p{L}\p{Nd}.\-_]+", "-"), "^-+|-+$", "")
    id_ = F.when(X.trim(plain) != "", plain).otherwise(F.concat(F.lit("doc-"), F.left(F.sha2(F.col("document_id").cast("string"), 256), F.lit(8))))

    info = X.trim(F.coalesce("info_title", F.lit("")))
    fit = (info != "") & ~info.rlike("(?iu)" + NO_TITLE) & ~F.lower(info).endswith(".pdf")
    shown = F.filter("ls", lambda x: (F.length(x) > 6) & ~x.rlike("(?iu)" + NO_TITLE_LINE) & ~x.rlike("(?iuU)" + CODE))
    both = F.array_join(F.slice(shown, 1, 2), " — ")
    coded = F.when((F.col("code") != "") & ~F.contains(F.lower(both), F.lower("code")), F.concat("code", F.lit(" — "), both)).otherwise(both)
    title = F.when(fit, info).when(F.size(shown) > 0, coded).otherwise(F.col("file_name"))

    line = _first(F.filter("ls", lambda x: x.rlike("(?iu)" + ORGANISATION)))
    organisation = F.regexp_extract(line, ORGANISATION_NAME, 0)
    company = F.coalesce(F.when(organisation != "", F.regexp_replace(organisation, '^[ «»"]+|[ «»"]+$', "")).otherwise(X.trim(line)), F.lit(""))
    person = X.trim(F.coalesce("info_author", F.lit("")))
    real = (person != "") & ~F.lower(person).contains("user") & ~F.lower(person).contains("admin")
    rows = rows.withColumns({"title": title, "company": company, "person": person})
    of_company = (F.col("company") != "") & ~F.contains(F.lower("person"), F.lower("company"))
    author = F.when(real, F.when(of_company, F.concat("person", F.lit(" ("), "company", F.lit(")"))).otherwise(F.col("person")))
    author = author.when(F.col("company") != "", F.col("company")).otherwise(F.lit(d.author))

    years = F.transform(_found(F.reverse("ls"), YEAR, "(?U)", 1), lambda y: y.cast("int"))
    year = _first(F.filter(years, lambda y: (y >= FIRST_YEAR) & (y <= F.year(today))))
    all_text = F.lower(F.concat("title", F.lit(" "), F.array_join("ls", " ")))
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    return rows.withColumn("all", all_text).select(
        "document_id", id_.alias("id"), F.when(folder.isin(SILOS), folder).otherwise(F.lit(d.silo)).alias("silo"), F.lit(d.department).alias("department"),
        F.coalesce(_first(_found(F.col("ls"), CITY, "(?iu)")), F.lit(d.office)).alias("office"), _named(F.col("all"), LEVELS, d.confidentiality_level).alias("confidentiality_level"),
        _named(F.col("all"), TYPES, d.document_type).alias("document_type"),
        F.coalesce(year, F.least(F.year("modified"), F.year(today)), F.year(today)).alias("fiscal_year"), author.alias("author"),
        F.coalesce("modified", today).alias("last_modified"), "title",
    )
