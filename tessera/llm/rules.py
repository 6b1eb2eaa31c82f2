"""Line-first quality rules, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import words

SYMBOLS, BRACKETS, BARS = "#*$%&|<>", r"{}\[\]\\^~_=", "|»•·"
BLANKS = r"\x20\x09-\x0D"
WINDOW = 8
#: From so many words on a line is judged by how often they repeat, and by whether a sentence ends in it.
REPEAT_WORDS, SOUP_WORDS = 10, 12
#: A line is a notice if phrases of notices are at least one part in so many of it.
NOTICE_PART = 4

#: Entries of menus, and phrases of notices, in English, French, German and Spanish. Other signs of both need no language: separators, addresses.
NAVIGATION = [
    "home", "menu", "login", "log in", "sign in", "sign up", "register", "subscribe", "share", "next", "previous", "back", "top", "search", "contact", "about", "sitemap", "read more", "more", "print", "reply", "follow us",
    "accueil", "connexion", "se connecter", "s'inscrire", "s'abonner", "partager", "suivant", "précédent", "retour", "recherche", "rechercher", "à propos", "plan du site", "lire la suite", "imprimer", "répondre", "suivez-nous",
    "startseite", "menü", "anmelden", "registrieren", "abonnieren", "teilen", "weiter", "zurück", "nach oben", "suche", "suchen", "kontakt", "impressum", "über uns", "weiterlesen", "mehr", "drucken", "antworten", "folgen sie uns",
    "inicio", "menú", "iniciar sesión", "registrarse", "suscribirse", "compartir", "siguiente", "anterior", "volver", "arriba", "buscar", "contacto", "acerca de", "mapa del sitio", "leer más", "más", "imprimir", "responder", "síguenos",
]
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "site uses cookies", "we use cookies", "accept cookies", "accept all cookies", "enable javascript", "requires javascript", "powered by", "lorem ipsum", "click here", "your browser",
    "tous droits réservés", "conditions d'utilisation", "politique de confidentialité", "mentions légales", "utilise des cookies", "accepter les cookies", "activer javascript", "propulsé par", "cliquez ici", "votre navigateur",
    "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "verwendet cookies", "cookies akzeptieren", "javascript aktivieren", "bereitgestellt von", "klicken sie hier", "ihr browser",
    "todos los derechos reservados", "condiciones de uso", "política de privacidad", "utiliza cookies", "aceptar cookies", "activar javascript", "con tecnología de", "haga clic aquí", "su navegador",
]
ENTRY = "(?:" + "|".join(NAVIGATION) + ")"
MENU = rf"^[{BLANKS}]*{ENTRY}(?:(?:[{BLANKS}]*[|>»•·/][{BLANKS}]*|[{BLANKS}]{{2,}}){ENTRY})*[{BLANKS}]*$"
YEAR = rf"^[{BLANKS}]*©[^\n]*|(?:©|\(c\)|copyright)[ ©(),a-z]{{0,9}}[0-9]{{4}}"
NOTICE = "(?:" + YEAR + "|" + "|".join(BOILERPLATE) + ")"
ADDRESS, SENTENCE_END = r"(?:https?://|www\.)[^\x20\x09-\x0D]", "[.!?…:;。！？]"

#: A line that is complete, one that goes on with the words of the line before, and where paragraphs part: before a blank line.
COMPLETE, GOES_ON = rf"{SENTENCE_END}[\"'”’»)\]]*[{BLANKS}]*$", rf"^[{BLANKS}]*\p{{Ll}}"
PARAGRAPH = r"\n(?=[\x20\x09\x0B-\x0D]*(?:\n|\z))"


def let(value: Column, then) -> Column:
    """`then(value)`, with `value` computed once a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def repeat_words(own: Column, window: int = WINDOW) -> Column:
    """How many words of the array `own` lie in windows of `window` words that occur twice or more in it.

    Window hashes are compared through a sort, so a very long text takes no more than n log n steps; texts without
    a repeated window, nearly all, stop after one set of hashes.
    """

    def windows(hashed: Column) -> Column:
        parts = lambda i: [F.element_at(hashed, (i + k).cast("int")) for k in range(window)]
        return F.transform(F.sequence(F.lit(1), F.size(hashed) - (window - 1)), lambda i: F.xxhash64(*parts(i)))

    def starts(found: Column) -> Column:
        ordered = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(by: Column) -> Column:
            near = lambda k, h: F.get(by, k)["h"].eqNullSafe(h)
            return F.filter(by, lambda x, k: near(k - 1, x["h"]) | near(k + 1, x["h"]))

        return let(ordered, lambda by: F.array_sort(F.transform(twice(by), lambda x: x["i"])))

    def covered(at: Column) -> Column:
        zero = F.struct(F.lit(-window).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, zero, lambda s, i: F.struct(i.cast("int").alias("last"), (s["n"] + F.least(i - s["last"], F.lit(window))).cast("bigint").alias("n")), lambda s: s["n"])

    def count(found: Column) -> Column:
        return F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0).cast("bigint")).otherwise(covered(starts(found)))

    hashed = F.transform(own, lambda w: F.xxhash64(w))
    return F.when(F.size(own) <= window, F.lit(0).cast("bigint")).otherwise(let(let(hashed, windows), count))


def counts(text: Column, own: Column) -> dict[str, Column]:
    """The base counts of a text with words `own`."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(rf"[^{BLANKS}]"))
    return {
        "word_chars": F.length(F.array_join(own, "")).cast("bigint"),
        "n_symbols": F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("bigint"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint"),
    }


def filled(text: Column) -> Column:
    """Characters of a text without white space."""
    return F.length(text) - F.regexp_count(text, F.lit(f"[{BLANKS}]"))


def is_wrapped(lines: Column) -> Column:
    """Whether lines break within sentences: at least half of those that aren't complete go on in the next one."""
    solid = f"[^{BLANKS}]"
    after = F.filter(lines, lambda x, i: F.get(lines, i - 1).rlike(solid) & ~F.get(lines, i - 1).rlike(COMPLETE) & x.rlike(solid))
    return let(after, lambda x: (F.size(x) > 0) & (2 * F.size(F.filter(x, lambda y: y.rlike(GOES_ON))) >= F.size(x)))


def judged_lines(text: Column) -> Column:
    """Lines as (line, ended): whether a sentence ends in it, or, where lines break within sentences, in its paragraph.

    Only lines of SOUP_WORDS words are asked, so without such a line that isn't ended paragraphs aren't looked at."""
    one = lambda line, ended: F.struct(line.alias("line"), ended.alias("ended"))
    lines = F.split(text, "\n")
    alone = F.transform(lines, lambda x: one(x, x.rlike(SENTENCE_END)))
    together = F.flatten(F.transform(F.split(text, PARAGRAPH), lambda p: let(p.rlike(SENTENCE_END), lambda ended: F.transform(F.split(p, "\n"), lambda x: one(x, ended)))))
    unsure = lambda own: F.exists(own, lambda x: ~x["ended"] & (F.length(x["line"]) >= 2 * SOUP_WORDS - 1))
    return let(alone, lambda own: F.when(unsure(own) & let(lines, is_wrapped), together).otherwise(own))


def line_fails(line: Column, ended: Column) -> Column:
    """Whether a line is removed: by its punctuation, as navigation, as boilerplate, as the same words over and over, or as
    words without a sentence (`ended`: there is one)."""

    def over(chars: str, share: float) -> Column:
        n = F.regexp_count(line, F.lit(f"[{chars}]"))
        return (n > 1) & (n > share * filled(line))

    bars = F.regexp_count(line, F.lit(f"[{BARS}]"))
    marked = over(SYMBOLS, 0.05) | over("!", 0.05) | over(BRACKETS, 0.1) | ((bars >= 2) & (bars * 40 > filled(line)))

    def by_words(own: Column) -> Column:
        n = F.size(own)
        hinted = let(F.lower(line), lambda low: F.greatest(*(F.instr(low, x) for x in (*BOILERPLATE, "©", "(c)", "copyright"))) > 0)  # nearly all lines end here
        phrases = F.length(line) - F.length(F.regexp_replace(line, f"(?iu){NOTICE}", ""))
        notice = (n > 0) & hinted & (NOTICE_PART * phrases >= filled(line))
        addresses = (n > 0) & line.rlike(ADDRESS) & (2 * F.regexp_count(line, F.lit(ADDRESS)) >= n)
        repeated = (n >= REPEAT_WORDS) & (F.size(F.array_distinct(own)) * 4 < n)
        soup = (n >= SOUP_WORDS) & ~ended
        return notice | addresses | repeated | soup

    return (line.rlike(f"[{SYMBOLS}!{BRACKETS}{BARS}]") & marked) | line.rlike(f"(?iu){MENU}") | let(words(line, fold=False), by_words)


def judge(docs: DataFrame, most_lost: float = 0.5, least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """A row for each document: doc_id, n_words, the base counts, base_failed, kept, and the cleaned text.

    Lines are judged first, by line_fails(), and those that fail are left out of `cleaned`; a document is kept if the base rules hold
    and no more than `most_lost` of its non-blank characters went with the lines. A null text has no words and fails,
    as an empty one does. Rows that repeat are judged each; other columns aren't read.
    """
    base = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), words(F.col("text"), fold=False).alias("own"))
    text, own = F.col("text"), F.col("own")
    got = base.select("doc_id", "text", F.size(own).cast("bigint").alias("n_words"), *(v.alias(k) for k, v in counts(text, own).items()), repeat_words(own).alias("n_repeat_words"), F.array_join(F.transform(F.filter(judged_lines(text), lambda x: ~line_fails(x["line"], x["ended"])), lambda x: x["line"]), "\n").alias("cleaned"))
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    left = F.when(F.col("cleaned") == text, F.col("word_chars")).otherwise(filled(F.col("cleaned")))
    got = got.withColumn("base_failed", failed)
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (left >= (1 - most_lost) * F.col("word_chars"))).alias("kept"), "cleaned")
