"""Texts of reports by language: a template for each kind of line, with places in braces, and the words of statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DATES = {"en": "yyyy-MM-dd", "tr": "dd.MM.yyyy"}
#: key: (English, Turkish). Keys of words begin with ``word.``.
TEXTS = {
    "title_single": ("# Review of one examination", "# Tek incelemenin değerlendirmesi"),
    "title_comparison": ("# Review of examinations over time", "# İncelemelerin zaman içinde değerlendirmesi"),
    "draft": ("> Draft by software. A physician has not approved it.", "> Yazılım taslağıdır. Hekim onayı yoktur."),
    "signed": ("> Read by {reader} on {date}", "> Okuyan: {reader}, {date}"),
    "studies": ("## Examinations", "## İncelemeler"),
    "study": ("- **{date}**: {modalities}; `{folder}`", "- **{date}**: {modalities}; `{folder}`"),
    "findings": ("## What was found", "## Saptananlar"),
    "region": ("- {region} ({word_status}): {text}", "- {region} ({word_status}): {text}"),
    "region_marked": ("- {region} ({word_status}): **{text}**", "- {region} ({word_status}): **{text}**"),
    "results": ("## Results", "## Sonuçlar"),
    "claim": ("{n}. [{claim}] {text}", "{n}. [{claim}] {text}"),
    "claim_marked": ("{n}. [{claim}] **{text}**", "{n}. [{claim}] **{text}**"),
    "measured": ("   - Measured: **{value} {unit}**, {method}", "   - Ölçülen: **{value} {unit}**, {method}"),
    "no_claims": ("No result stands on its own; read the regions together.", "Tek başına bir sonuç yok; bölgeler birlikte okunmalıdır."),
    "timeline": ("## Over time", "## Zaman içinde"),
    "point": ("- [{claim}] **{date}**: {text}", "- [{claim}] **{date}**: {text}"),
    "guide_title": ("# The review in plain words", "# Değerlendirmenin sade anlatımı"),
    "guide_note": ("> It explains the review and is no diagnosis.", "> Değerlendirmeyi açıklar, tanı değildir."),
    "guide_claim": ("## {claim}: {text}", "## {claim}: {text}"),
    "meaning": ("**What it is:** {text}", "**Nedir:** {text}"),
    "importance": ("**Why it matters:** {text}", "**Neden önemli:** {text}"),
    "uncertainty": ("**What is open:** {text}", "**Açık kalan:** {text}"),
    "ask": ("**What to ask:** {text}", "**Ne sorulmalı:** {text}"),
    "guide_regions": ("## Every region", "## Bütün bölgeler"),
    "guide_region": ("- {region}, {word_status}: {explanation}", "- {region}, {word_status}: {explanation}"),
    "guide_point": ("- **{date}**: {explanation}", "- **{date}**: {explanation}"),
    "word.finding": ("finding", "bulgu"),
    "word.no_finding": ("nothing found", "bulgu yok"),
    "word.limited": ("seen in part", "kısmen görüldü"),
    "word.not_covered": ("not in the images", "görüntüde yok"),
}


def languages(spark: SparkSession) -> DataFrame:
    """(lang, dates, texts): a row for each language, its date format and its texts by key."""
    rows = [(lang, DATES[lang], {k: v[i] for k, v in TEXTS.items()}) for i, lang in enumerate(DATES)]
    return spark.createDataFrame(rows, "lang string, dates string, texts map<string,string>")


def filled_in(template: Column, values: Column) -> Column:
    """A template with its places ({name}) filled from a map; a place without a value stays as it is, and braces within values aren't places."""
    pieces = F.split(template, r"(?=\{[a-z_]+\})|(?<=[a-z_]\})")
    name = lambda p: F.regexp_extract(p, r"^\{([a-z_]+)\}$", 1)
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(values, name(p)), p)), "")


def date_in(date: Column, dates: Column) -> Column:
    """A date of eight digits in a language's format; any other text as it is."""
    y, m, d = (F.substring(date, *x) for x in ((1, 4), (5, 2), (7, 2)))
    valid = F.try_to_date(F.substring(date, 1, 8), "yyyyMMdd").isNotNull()
    return F.when(valid, F.replace(F.replace(F.replace(dates, F.lit("yyyy"), y), F.lit("MM"), m), F.lit("dd"), d)).otherwise(date)
