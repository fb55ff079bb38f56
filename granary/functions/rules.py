"""Rule-based classifiers and extractors as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import ERROR_CODE, stripped

#: Words and patterns of the section and query classifiers.
SECTION_ERROR = ("errore", "error", "codice", "avviso", "warning")
SECTION_PARAMETER = ("parametro", "impostazione", "configurazione", "settaggio", "opzione")
SECTION_PROCEDURE = ("procedura", "come", "step", "passo", "istruzione", "guida")
SECTION_TABLE = ("tabella", "elenco", "lista")
SECTION_FAQ = ("faq", "domande")
SKIPPED_TITLES = ("menu", "navigation", "header", "footer", "sidebar", "cookie", "privacy", "copyright", "condividi", "share")
QUERY_ERROR = (r"\b[A-Z]{2,4}-?\d{2,4}\b", r"\b(?:errore|error|avviso|warning|codice)\b", r"\bnon\s+(?:funziona|va|riesco)\b")
QUERY_PARAMETER = (r"\b(?:param|impostaz|valori|predefin|default|range)\b", r"\bcome\s+(?:impostare|configurare|settare)\b", r"\bdove\s+(?:trovo|si trova)\b", r"\bvalori?\s+(?:ammessi|possibili|consentiti)\b")
QUERY_PROCEDURE = (r"\bcome\s+(?:fare|eseguire|effettuare)\b", r"\b(?:procedura|processo|step|passi)\b", r"\bper\s+(?:creare|generare|stampare|inviare)\b", r"\b(?:configurare|impostare)\s+.*\b")
PARAM_NAMES = (r"(?i)Parametro\s+([^:\n]+)", r"(?i)Impostazione\s+([^:\n]+)", r"(?i)Campo\s+([^:\n]+)")
COMPLEX_WORDS = ("come", "perché", "perchè", "spiegare", "spiegami", "differenza", "confronto", "esempi", "procedura completa", "passo passo", "dettagli")
STEP_START = r"^(\d+\)\s+|-\s+|•\s+|(?i:Step\s+\d+)|(?i:Passo\s+\d+))"
#: Fixed values: (k_dense, k_lexical) and factors of the boosts by query type.
K_VALUES = {"error": (20, 40), "parameter": (28, 26), "procedure": (52, 14), "general": (40, 20)}
BOOST_FACTORS = {"error": ("error_code", 2.0), "parameter": ("param_name", 1.5), "procedure": ("title", 1.3)}


def any_word(text: Column, words: tuple[str, ...]) -> Column:
    """Whether one of the words stands anywhere, inside other words too."""
    return F.lower(text).rlike("|".join(words))


def section_type(title: Column, content: Column, has_codes: Column | None = None) -> Column:
    """The first of error, parameter, procedure, table, faq that applies, else concept."""
    error = any_word(content, SECTION_ERROR)
    return (
        F.when(error if has_codes is None else error | has_codes, F.lit("error"))
        .when(any_word(title, SECTION_PARAMETER), F.lit("parameter"))
        .when(any_word(content, SECTION_PROCEDURE), F.lit("procedure"))
        .when(any_word(title, SECTION_TABLE), F.lit("table"))
        .when(any_word(title, SECTION_FAQ), F.lit("faq"))
        .otherwise(F.lit("concept"))
    )


def query_type(query: Column) -> Column:
    """error, parameter, procedure or general. Queries are put in small letters first, so a bare code is general."""
    low = F.lower(query)
    hit = lambda patterns: low.rlike("(?U)" + "|".join(patterns))
    return F.when(hit(QUERY_ERROR), F.lit("error")).when(hit(QUERY_PARAMETER), F.lit("parameter")).when(hit(QUERY_PROCEDURE), F.lit("procedure")).otherwise(F.lit("general"))


def k_dense(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (d, _) in K_VALUES.items() for x in (k, d)]), kind)


def k_lexical(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for k, (_, x) in K_VALUES.items() for x in (k, x)]), kind)


def boost(kind: Column, name: str, base: float) -> Column:
    out = F.lit(base)
    for k, (field, factor) in BOOST_FACTORS.items():
        if field == name:
            out = F.when(kind == k, F.lit(base * factor)).otherwise(out)
    return out


def wants_model(query: Column, kind: Column) -> Column:
    """Whether a query is complex: two points of length, words, several questions, general type."""
    points = F.when(F.length(query) > 50, 1).otherwise(0) + F.when(any_word(query, COMPLEX_WORDS), 2).otherwise(0) + F.when(F.length(query) - F.length(F.replace(query, F.lit("?"))) > 1, 1).otherwise(0) + F.when(kind == "general", 1).otherwise(0)
    return points >= 2


def skipped_section(title: Column, content: Column, least: int = 100) -> Column:
    return (F.length(content) < least) | (stripped(content) == "") | any_word(title, SKIPPED_TITLES)


def first_match(text: Column, *patterns: str) -> Column:
    return F.coalesce(*[F.nullif(stripped(F.regexp_extract(text, p, 1)), F.lit("")) for p in patterns])


#: Words before a name in a question, and before the facts of parameters, procedures and errors; the shape of descriptions,
#: bullet points, lines that look like titles, and of numbers that an answer must have from its sources.
NAMED_BY = ("parametro", "impostazione", "campo")
LABELS = {
    "allowed_values": "valori|opzioni", "default_value": "default|predefinito", "constraints": r"(?:vincol|limitazion)\w*",
    "prerequisites": r"(?:prerequisit|prima di)\w*", "warnings": "attenzione|avviso|warning", "cause": r"(?:causa|motivo|dovuto)\w*",
}
NO_DESCRIPTION, BULLET, TITLE_LINE, LONG_NUMBER = r"^[*#]", r"^[-•*]\s+", r"(?md)^([A-Z][^.]+)$", r"\d{3,}"


def param_name(text: Column) -> Column:
    return first_match(text, *PARAM_NAMES)


def section_param_name(kind: Column, title: Column, content: Column) -> Column:
    return F.when(kind == "parameter", param_name(F.concat_ws(" ", title, F.substring(content, 1, 200))))


def query_param_name(query: Column) -> Column:
    low = F.lower(query)
    return F.initcap(F.coalesce(*[F.nullif(F.regexp_extract(low, rf"""{w}\s+["']?([^"'\s]+)["']?""", 1), F.lit("")) for w in NAMED_BY]))


def query_error_code(query: Column, from_results: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(F.upper(query), ERROR_CODE, 0), F.lit("")), from_results)


def labelled_value(text: Column, words: str, signs: str = ":=") -> Column:
    """What follows one of the words and a sign, up to the end of the line."""
    return first_match(text, rf"(?i)(?:{words})\s*[{signs}]\s*([^\n]+)")


def parameter_info(content: Column) -> Column:
    lines = F.filter(F.transform(F.split(content, "\n"), stripped), lambda x: (F.length(x) > 20) & ~x.rlike(NO_DESCRIPTION))
    return F.struct(
        F.get(lines, 0).alias("description"),
        labelled_value(content, LABELS["allowed_values"]).alias("allowed_values"),
        labelled_value(content, LABELS["default_value"]).alias("default_value"),
        labelled_value(content, LABELS["constraints"]).alias("constraints"),
    )


#: Step marks, words before a resolution, verbs of key points.
STEP_MARK, NUMBER_MARK = r"^(?:\d+[.)]|[-•])\s+", r"^\d+[.)]\s+"
RESOLUTIONS = ("risoluzione|soluzione", "per risolvere|correggere")
ACTION_VERBS = "chiudendo|calcolando|generando|producendo|fornendo"
FEATURE_VERBS = "permette|consente|agevola|gestisce|include"


def without_mark(lines: Column, mark: str) -> Column:
    """The lines that begin with a mark and have something after it, the mark taken off."""
    marked = F.filter(lines, lambda x: x.rlike(mark + "."))
    return F.transform(marked, lambda x: F.regexp_replace(x, mark, ""))


def procedure_info(content: Column) -> Column:
    return F.struct(
        without_mark(F.transform(F.split(content, "\n"), stripped), STEP_MARK).alias("steps"),
        labelled_value(content, LABELS["prerequisites"]).alias("prerequisites"),
        labelled_value(content, LABELS["warnings"], ":!").alias("warnings"),
    )


def error_info(content: Column, code: Column) -> Column:
    """The message after the asked code, the cause, and the steps of the resolution: its first line, and all numbered ones."""
    after = F.when(F.contains(content, code) & (code != ""), F.substr(content, F.instr(content, code) + F.length(code)))
    block = F.coalesce(*[F.nullif(stripped(F.regexp_extract(content, rf"(?is)(?:{words})\s*[:=]\s*(.+?)(?=\n\n|\z)", 1)), F.lit("")) for words in RESOLUTIONS])
    lines = F.filter(F.transform(F.split(block, "\n"), stripped), lambda x: x != "")
    opening = F.filter(F.slice(lines, 1, 1), lambda x: ~x.rlike(NUMBER_MARK))
    return F.struct(
        F.nullif(stripped(F.regexp_extract(after, r"^[:\-]?\s*([^\n]+)", 1)), F.lit("")).alias("message"),
        labelled_value(content, LABELS["cause"]).alias("cause"),
        F.concat(opening, without_mark(lines, NUMBER_MARK)).alias("resolution"),
    )


def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))


def key_points(content: Column, most: int = 4) -> Column:
    """Bullet points; without any, what follows verbs of action, then of features, then lines that look like titles."""
    bullets = without_mark(F.transform(F.split(content, "\n"), stripped), BULLET)
    both = lambda pattern: F.arrays_zip(F.regexp_extract_all(content, F.lit(pattern), F.lit(1)).alias("verb"), F.regexp_extract_all(content, F.lit(pattern), F.lit(2)).alias("rest"))
    acting = F.filter(both(rf"(?is)\b({ACTION_VERBS})\s+((?:(?!\b(?:{ACTION_VERBS})\s).)*)"), lambda x: F.length(stripped(x["rest"])) > 10)
    actions = F.transform(acting, lambda x: F.concat_ws(" ", capitalized(x["verb"]), F.array_join(F.slice(F.split(stripped(x["rest"]), r"\s+"), 1, 8), " ")))
    featured = F.filter(both(rf"(?i)\b({FEATURE_VERBS})\s+([^.]+)"), lambda x: F.length(stripped(x["rest"])) > 15)
    features = F.transform(featured, lambda x: F.concat_ws(" ", capitalized(x["verb"]), stripped(x["rest"])))
    titled = F.filter(F.regexp_extract_all(content, F.lit(TITLE_LINE), F.lit(1)), lambda x: (F.length(stripped(x)) > 5) & ~F.contains(F.substring(content, 1, 100), x))
    pick = F.when(F.size(bullets) > 0, bullets).when(F.size(actions) > 0, actions).when(F.size(features) > 0, features).otherwise(F.transform(titled, stripped))
    return F.slice(pick, 1, most)


def unsupported_numbers(answer: Column, sources: Column) -> Column:
    """Numbers of three digits or more in the answer that no source has (a metric; it rejects nothing)."""
    numbers = lambda t: F.regexp_extract_all(t, F.lit(LONG_NUMBER), F.lit(0))
    return F.array_except(numbers(answer), numbers(sources))


def valid_answer(answer: Column, least: int = 50, citation: bool = False) -> Column:
    ok = (F.length(answer) >= least) & ~F.contains(answer, F.lit("{{")) & ~F.contains(answer, F.lit("}}"))
    return ok & F.contains(answer, F.lit("Fonti:")) if citation else ok
