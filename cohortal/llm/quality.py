"""Quality rules, line first: drop failing lines, then documents that lose too much."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.llm.text import BLANKS, WORDS, small_batches

SYMBOLS = "#*$%&|<>"
# Phrases of navigation bars and of legal or technical boilerplate in English, German, French and Spanish.
# Those that are found within a line start and end with ASCII letters, as word ends differ between engines elsewhere.
NAVIGATION = (
    "home|menu|main menu|next|previous|prev|read more|more|sign in|sign up|log in|login|log out|logout|register|"
    "subscribe|share|share this|tweet|print|email this|search|skip to content|back to top|top|contact|contact us|"
    "about|about us|sitemap|help|faq|categories|archives|tags|comments|reply|follow us|click here|loading|"
    "startseite|hauptmenü|weiter|zurück|mehr lesen|weiterlesen|anmelden|abmelden|registrieren|abonnieren|teilen|drucken|kontakt|über uns|"
    "zum inhalt springen|nach oben|kategorien|kommentare|antworten|folgen sie uns|hier klicken|impressum|"
    "accueil|menu principal|suivant|précédent|lire la suite|en savoir plus|se connecter|connexion|déconnexion|s'inscrire|s'abonner|partager|imprimer|"
    "contactez-nous|à propos|plan du site|aller au contenu|haut de page|catégories|commentaires|répondre|suivez-nous|cliquez ici|"
    "página principal|menú|menú principal|siguiente|anterior|leer más|iniciar sesión|cerrar sesión|registrarse|suscribirse|compartir|imprimir|"
    "contacto|quiénes somos|sobre nosotros|mapa del sitio|ir al contenido|categorías|comentarios|responder|síguenos|haga clic aquí"
)
BOILERPLATE = (
    "cookies?|privacy policy|terms of (?:use|service)|terms and conditions|all rights reserved|copyright|"
    "javascript|enable scripts|your browser|newsletter|powered by|lorem ipsum|page not found|advertisement|"
    "unsubscribe|opt out|"
    "alle rechte vorbehalten|urheberrecht|nutzungsbedingungen|allgemeine gesch.ftsbedingungen|seite nicht gefunden|newsletter abbestellen|ihr browser|"
    "tous droits r.serv.s|politique de confidentialit|mentions l.gales|conditions d'utilisation|conditions g.n.rales|page introuvable|votre navigateur|"
    "todos los derechos reservados|derechos de autor|pol.tica de privacidad|aviso legal|t.rminos y condiciones|condiciones de uso|su navegador"
)
NAV_ITEM = re.compile(rf"(?:{NAVIGATION})", re.I)
NAV_SPLIT = re.compile(r"\s*[|»›>·•/]\s*|\s{2,}|\t")
BOILER = re.compile(rf"\b(?:{BOILERPLATE})\b|©", re.I)
SENTENCE_MARK = re.compile(r"[.!?…:;。！？]")
LOUD = re.compile(r"[!?]{2,}")

RESULT = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_failed_lines long, n_lost_words long, clean_text string"
)


def line_fault(words: list[str], line: str) -> str | None:
    """The rule that a line with at least one word fails, or None."""
    n = len(words)
    if sum(map(line.count, SYMBOLS)) > 0.3 * n and n >= 3:
        return "punctuation"
    if n >= 4 and len(LOUD.findall(line)) > 0.3 * n:
        return "punctuation"
    if n >= 8 and not SENTENCE_MARK.search(line):
        return "punctuation"
    if n >= 6 and sum(a == b for a, b in zip(words, words[1:], strict=False)) > 0.4 * n:
        return "boilerplate"
    if n <= 12:
        items = [x for x in NAV_SPLIT.split(line.strip()) if x]
        if items and sum(bool(NAV_ITEM.fullmatch(x.strip(" .:»›<>"))) for x in items) > 0.5 * len(items):
            return "navigation"
    if n <= 30 and BOILER.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words in windows of ``window`` words whose wording occurs twice or more in the text."""
    n = len(words)
    if n <= window:
        return 0
    seen: dict[str, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    if len(seen) == n:
        return 0
    key = ids
    for k in range(1, window):  # ranks keep the key exact: it never exceeds n * len(seen)
        key = key[:-1] * len(seen) + ids[k:]
        if k == window - 1 or (int(key.max()) + 1) * len(seen) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    if not twice.any():
        return 0
    covered = np.zeros(n, bool)
    for k in range(window):
        covered[k : k + len(twice)] |= twice
    return int(covered.sum())


def clean(text: str | None) -> tuple:
    """All counts of a text, and the text without its failing lines."""
    text = text or ""
    words = WORDS.findall(text)
    kept, lines, with_word, failed, lost = [], text.split("\n"), [], 0, 0
    for line in lines:
        own = WORDS.findall(line)
        if own:
            with_word.append(line)
            if line_fault(own, line):
                failed += 1
                lost += len(own)
                continue
        kept.append(line)
    return (
        len(words),
        len(text) - sum(map(text.count, BLANKS)),
        sum(map(text.count, SYMBOLS)),
        len(with_word) - len(set(with_word)),
        repeated_words(words),
        len(with_word),
        failed,
        lost,
        "\n".join(kept) if failed else text,
    )


def line_quality(
    docs: DataFrame,
    text: str = "text",
    id: str = "doc_id",
    min_words: int = 10,
    max_repeat_share: float = 0.2,
    max_lost_share: float = 0.5,
    with_text: bool = True,
) -> DataFrame:
    """Judge every line, remove those that fail, then reject documents that lost too much.

    One row per input row: the id, the counts of the whole text, the counts of the line
    stage, ``base_failed``, ``kept`` and, on request, ``clean_text`` (the text without its
    failing lines). No shuffle; each text is handled alone in an Arrow batch.

    A null or empty text has no words and fails the base rule. Null and repeated ids pass
    through. Columns other than ``id`` and ``text`` are not looked at.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf(RESULT)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        for texts in batches:
            found = pd.DataFrame([clean(t) for t in texts], columns=names)
            if not with_text:
                found["clean_text"] = None
            yield found

    out = docs.select(F.col(id).alias("doc_id"), scan(F.col(text)).alias("q")).select("doc_id", "q.*")
    share = F.lit(100) * F.col("n_repeat_words") > F.lit(100 * max_repeat_share) * F.col("n_words")
    out = out.withColumn("base_failed", (F.col("n_words") < min_words) | share)
    lost = F.col("n_lost_words") > F.lit(max_lost_share) * F.col("n_words")
    out = out.withColumn("kept", ~F.col("base_failed") & ~lost)
    return out if with_text else out.drop("clean_text")
