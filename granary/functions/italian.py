"""Italian analysis of texts as column expressions: elision, accents, function words, a light stemmer, synonyms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Groups of words that count as one.
SYNONYMS = (
    "impostazione,impostaz,settaggio,configurazione,config",
    "parametro,parametr,opzione,campo",
    "procedura,processo,guida,istruzione",
    "errore,error,codice,avviso,warning",
    "fattura,fatturazione,documento",
    "cliente,anagrafica,soggetto",
    "articolo,prodotto,merce",
    "iva,imposta,aliquota",
    "contabilita,contabilità,coge",
    "magazzino,giacenza,stock",
)
ACCENTS = ("àáâäèéêëìíîïòóôöùúûüçñ", "aaaaeeeeiiiioooouuuucn")
#: Articles and prepositions that lose their last vowel before an apostrophe.
ELIDED = r"(?U)(?<![\p{L}\p{N}_])(?:l|un|d|c|m|t|s|v|gl|(?:a|da|de|ne|su|co|pe)ll|(?:a|da|de|ne|su)gl)['’](?=\p{L})"
#: The two letters or the one that a word of six letters or more loses at its end, the longer first.
SUFFIX, LEAST = "(?:[ih]e|[ih]i|i[ao]|[aeio])$", 6


def stop_words() -> frozenset[str]:
    """Function words, and the forms of the auxiliary verbs made from their stems; without accents."""
    words = set(
        "a ad al allo ai agli all agl alla alle con per tra fra contro da di in su e ed o od ma se che chi cui non ne ci vi si mi ti lo la li le gli il i un uno una "
        "io tu lui lei noi voi loro come dove dov quale quanto quanti quanta quante anche piu perche tutto tutti c l".split()
    )
    words |= {p + end for p in ("da", "de", "ne", "su") for end in ("l", "llo", "ll", "lla", "lle", "i", "gli", "gl")} | {"col", "coi"}
    words |= {owner + end for owner, ends in (("m", "io ia iei ie"), ("t", "uo ua uoi ue"), ("s", "uo ua uoi ue"), *((x, "o a i e") for x in ("nostr", "vostr", "quest", "quell"))) for end in ends.split()}
    for stem in ("avr", "sar", "far", "star"):  # future and conditional
        words |= {stem + end for end in "o ai a emo ete anno ei esti ebbe emmo este ebbero".split()}
    for stem, vowel in (("av", "e"), ("fac", "e"), ("st", "a")):  # imperfect
        words |= {stem + vowel + end for end in "vo vi va vamo vate vano".split()}
    for stem in ("ave", "fo", "face", "ste"):  # past subjunctive
        words |= {stem + end for end in "ssi sse ssimo ssero".split()}
    words |= set(
        "ho hai ha abbiamo avete hanno abbia abbiate abbiano ebbi avesti ebbe avemmo aveste ebbero avendo avuto avuta avuti avute "
        "sono sei e siamo siete sia siate siano ero eri era eravamo eravate erano fui fosti fu fummo foste furono essendo "
        "faccio fai facciamo fanno faccia facciate facciano feci facesti fece facemmo faceste fecero facendo "
        "sto stai sta stiamo stanno stia stiate stiano stetti stesti stette stemmo steste stettero stando".split()
    )
    return frozenset(words)


def folded(text: Column) -> Column:
    """Small letters without accents."""
    return F.translate(F.lower(text), *ACCENTS)


def stemmed(word: Column) -> Column:
    """A folded word without its ending: plural, gender, and the i or h that only softens it; short words stay."""
    return F.when(F.length(word) >= LEAST, F.regexp_replace(word, SUFFIX, "")).otherwise(word)


def plain_stem(word: str) -> str:
    """The same for one word, to prepare word lists."""
    import re

    word = word.lower().translate(str.maketrans(*ACCENTS))
    return re.sub(SUFFIX, "", word) if len(word) >= LEAST else word


def meanings(synonyms: tuple[str, ...] = SYNONYMS) -> tuple[dict[str, str], dict[str, str]]:
    """(stem: head) of single words and of phrases, a group's head being its first entry's stems joined by ``_``."""
    single, phrases = {}, {}
    for group in synonyms:
        entries = [[s for w in entry.split() if (s := plain_stem(w)) not in stop_words()] for entry in group.split(",")]
        head = "_".join(entries[0])
        for entry in entries:
            (phrases if len(entry) > 1 else single)[" ".join(entry)] = head
    return single, phrases


def words(text: Column) -> Column:
    """Folded words without elided articles; letters, digits and underscores make a word."""
    bare = F.regexp_replace(F.lower(text), ELIDED, "")
    return F.filter(F.split(F.translate(bare, *ACCENTS), r"(?U)[^\p{L}\p{N}_]+"), lambda w: w != "")


def tokens(text: Column, synonyms: tuple[str, ...] = SYNONYMS) -> Column:
    """The stems of a text's words without function words, those of a group of synonyms as one; phrases of the groups count too."""
    stop, (single, phrases) = sorted(stop_words()), meanings(synonyms)
    found = F.transform(F.filter(words(text), lambda w: ~w.isin(stop)), stemmed)
    for phrase, head in sorted(phrases.items(), key=lambda x: (-len(x[0]), x)):  # the longest first
        found = F.split(F.regexp_replace(F.array_join(found, " "), rf"(?<![^ ]){phrase}(?![^ ])", head), " ")
    if phrases:
        found = F.filter(found, lambda w: w != "")
    table = F.create_map(*[F.lit(x) for pair in sorted(single.items()) for x in pair]) if single else None
    return found if table is None else F.transform(found, lambda w: F.coalesce(F.try_element_at(table, w), w))
