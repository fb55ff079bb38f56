"""The five layouts of an answer, each from the facts of a question's first source and the list of all sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.rules import error_info, parameter_info, procedure_info

#: Labels of the layouts, the text and the tips of an answer that was not found.
SOURCES, MODULE, UI_PATH, DESCRIPTION, VALUES = "**Fonti**:", "**Modulo**: ", "**Percorso**: ", "**Descrizione**: ", "**Valori ammessi**: "
DEFAULT, CONSTRAINTS, VERSION = "**Valore predefinito**: ", "**Vincoli**: ", "**Versioni**: Disponibile dalla versione "
PREREQUISITES, PROCEDURE, WARNING = "**Prerequisiti**: ", "**Procedura**:", "⚠️ **Attenzione**: "
CAUSE, RESOLUTION, TOPICS = "**Causa probabile**: ", "**Risoluzione**:", "**Argomenti correlati**: "
NOT_FOUND, RELATED, TIPS_HEAD = "**Informazione non trovata**", "**Sezioni correlate che potrebbero essere utili**:", "**Suggerimenti per la ricerca**:"
NOT_FOUND_TEXT = "L'informazione richiesta non è disponibile nella documentazione indicizzata."
TIPS = (
    "Prova a utilizzare sinonimi o termini alternativi",
    "Verifica la versione del modulo a cui ti riferisci",
    'Includi il nome del modulo nella ricerca (es. "Contabilità", "Fatturazione")',
    'Per errori, indica il codice completo (es. "IVA-102")',
)


def optional(label: str, value: Column) -> Column:
    """The label and the value, or an empty line."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value)).otherwise(F.lit(""))


def known(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def listed(items: Column) -> Column:
    """Each item on a line of its own after an empty one; an empty list gives an empty line."""
    return F.array_join(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.concat(F.lit("\n"), x, F.lit("\n"))), "")


def numbered(items: Column) -> Column:
    return listed(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)))


def linked(sources: Column, anchors: bool = True) -> Column:
    """Sources (title, url, anchor) as links."""
    anchor = lambda x: F.when(known(x["anchor"]) != "", F.concat(F.lit("#"), x["anchor"])).otherwise(F.lit("")) if anchors else F.lit("")
    return listed(F.transform(sources, lambda x: F.concat(F.lit("- ["), known(x["title"]), F.lit("]("), known(x["url"]), F.lit(")"), anchor(x))))


def lines(*parts: Column | str) -> Column:
    return F.concat_ws("\n", *[F.lit(p) if isinstance(p, str) else p for p in parts])


def bold(*parts: Column | str) -> Column:
    return F.concat(F.lit("**"), *[F.lit(p) if isinstance(p, str) else known(p) for p in parts], F.lit("**"))


def parameter(name: Column, module: Column, path: Column, version: Column, content: Column, sources: Column) -> Column:
    info = parameter_info(content)
    facts = [optional(VALUES, info["allowed_values"]), optional(DEFAULT, info["default_value"]), optional(CONSTRAINTS, info["constraints"])]
    # no source names dependencies, related errors or notes, so their lines stay empty
    return lines(bold("Parametro: ", name), "", optional(MODULE, module), optional(UI_PATH, path), "", F.concat(F.lit(DESCRIPTION), known(info["description"])), "", *facts, "", "", "", "", "", "", optional(VERSION, version), "", SOURCES, linked(sources))


def procedure(title: Column, module: Column, content: Column, sources: Column) -> Column:
    info = procedure_info(content)
    # nor variants or an expected result
    return lines(bold(title), "", optional(MODULE, module), optional(PREREQUISITES, info["prerequisites"]), "", PROCEDURE, numbered(info["steps"]), "", "", "", "", "", optional(WARNING, info["warnings"]), "", SOURCES, linked(sources))


def error(code: Column, module: Column, content: Column, sources: Column) -> Column:
    info = error_info(content, known(code))
    named = F.coalesce(F.nullif(code, F.lit("")), F.lit("N/A"))
    # nor prevention or related parameters
    return lines(bold("Errore ", named, ": ", info["message"]), "", optional(MODULE, module), "", F.concat(F.lit(CAUSE), known(info["cause"])), "", RESOLUTION, numbered(info["resolution"]), "", "", "", "", "", SOURCES, linked(sources))


def general(title: Column, combined: Column, topics: Column, sources: Column) -> Column:
    return lines(bold(title), "", known(combined), "", "", "", optional(TOPICS, F.array_join(topics, ", ")), "", SOURCES, linked(sources))


def fallback(suggested: Column) -> Column:
    related = F.when(F.size(suggested) > 0, lines(RELATED, linked(suggested, anchors=False))).otherwise(F.lit(""))
    tips = listed(F.array(*[F.lit(f"- {t}") for t in TIPS]))
    return lines(NOT_FOUND, "", NOT_FOUND_TEXT, "", related, "", lines(TIPS_HEAD, tips))


def rendered(kind: Column, facts: dict[str, Column], sources: Column) -> Column:
    """The layout of the question's type. facts: name, code, title, module, version, ui_path, content, combined, topics."""
    f = facts
    return (
        F.when(kind == "parameter", parameter(f["name"], f["module"], f["ui_path"], f["version"], f["content"], sources))
        .when(kind == "procedure", procedure(f["title"], f["module"], f["content"], sources))
        .when(kind == "error", error(f["code"], f["module"], f["content"], sources))
        .otherwise(general(f["title"], f["combined"], f["topics"], sources))
    )
