"""SCL-20: whether a query asks or searches. Word borders are ASCII, as in the client's language."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that decide, as regular expressions.
QUESTION = r"[?¿]"
QUESTION_WORD = r"^\s*(qué|que|cómo|como|cuándo|cuando|dónde|donde|por\s+qué|cuál|cual|quién|quien|cuántos?|cuantos?|what|how|when|where|why|which|who|is\s+there|are\s+there|can\s+you)"
IMPERATIVE = r"(explica|expl[ií]came|resume|res[uú]meme|describe|analiza|compara|lista|extrae|define|diferencia|relaciona|cu[eé]ntame|dime|mu[eé]strame|h[aá]blame|ay[uú]dame|necesito\s+saber|quiero\s+saber|dame\s+información|busca\s+información|tell\s+me|explain|summarize|describe|compare|analyze|show\s+me|help\s+me|find\s+out)"
INFORMATION = r"(qué\s+es|qué\s+son|cómo\s+(es|funciona|se\s+hace|fue|eran)|por\s+qué|para\s+qué|en\s+qué\s+(consiste|se\s+diferencia)|cuál\s+es\s+(la|el)|quién\s+(es|fue|era|inventó|creó|fundó)|qué\s+diferencia|qué\s+(pasó|ocurrió|sucedió)|información\s+(sobre|de|acerca\s+de)|datos\s+sobre|historia\s+de|cómo\s+funciona|how\s+(does|is|was)|what\s+is|who\s+(is|was)|why\s+(is|did|was))"
FILE_EXTENSION = r"\.[A-Za-z0-9_]{2,5}(\s|$)"
DOCUMENT_CODE = r"([A-Z]{1,4}-?[0-9]{3,}|Q[1-4]\s*[0-9]{4}|ref\.?\s*[A-Za-z0-9_-]+|ID\s*:?\s*[0-9]+|exp\.?\s*[0-9]{4}[/-][0-9]+)"

_WORD = "[A-Za-z0-9_]"
#: An ASCII word border: between a word character and none.
_EDGE = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def patterns() -> dict[str, str]:
    """Java expressions of the signals, borders spelled out."""
    return {
        "question": QUESTION, "question_word": f"(?iu){QUESTION_WORD}{_EDGE}", "imperative": f"(?iu){_EDGE}{IMPERATIVE}{_EDGE}",
        "information": f"(?iu){_EDGE}{INFORMATION}{_EDGE}", "extension": FILE_EXTENSION, "code": f"(?i){_EDGE}{DOCUMENT_CODE}{_EDGE}",
    }


def route(query: Column) -> Column:
    """"ask" or "search"; null and blank queries search."""
    q = F.regexp_replace(F.coalesce(query, F.lit("")), r"^\s+|\s+$", "")
    p = patterns()
    asks = q.rlike(p["question"]) | q.rlike(p["question_word"]) | q.rlike(p["imperative"]) | q.rlike(p["information"])
    finds = q.rlike(p["extension"]) | q.rlike(p["code"])
    return F.when(q == "", "search").when(asks, "ask").when(finds, "search").when(F.size(F.split(q, r"\s+")) <= 2, "search").otherwise("ask")
