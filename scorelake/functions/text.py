"""Text scoring as column expressions; every function takes and returns Columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ---------------------------------------------------------------
# Unicode white space, as characters and as a pattern.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85"
    "\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_RUN = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
)
WORD_TOKEN = r"[\p{L}\p{N}_]{2,}"
FACT_PATTERNS = (
    r"\b\d+(?:\.\d+)?%?\b",
    r"\b\d{4}\b",
    r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
    r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
)
FACT_VERBS = ("is", "are", "was", "were", "has", "have", "had")
CONNECTORS = (
    "however", "therefore", "furthermore", "moreover", "additionally", "consequently", "thus",
    "hence", "as a result", "in conclusion",
)
CONCLUSIONS = ("in conclusion", "to summarize", "overall", "therefore", "thus")
STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves "
    "he him his himself she she's her hers herself it it's its itself they them their theirs themselves "
    "what which who whom this that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of at by for with about "
    "against between into through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don don't should should've "
    "now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn "
    "hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()
# The vectoriser behind relevance leaves out another list: the one above without these words and without
# contractions, and the words after them.
NOT_FOR_RELEVANCE = (
    "s t d ll m o ve y ma "
    "theirs having does did doing just don ain aren couldn didn doesn hadn hasn haven isn mightn mustn needn shan "
    "shouldn wasn weren won wouldn"
).split()
MORE_FOR_RELEVANCE = (
    "across afterwards almost alone along already also although always among amongst amoungst amount another "
    "anyhow anyone anything anyway anywhere around back became become becomes becoming beforehand behind beside "
    "besides beyond bill bottom call cannot cant co con could couldnt cry de describe detail done due eg eight "
    "either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except fifteen "
    "fifty fill find fire first five former formerly forty found four front full get give go hasnt hence "
    "hereafter hereby herein hereupon however hundred ie inc indeed interest keep last latter latterly least less "
    "ltd made many may meanwhile might mill mine moreover mostly move much must name namely neither never "
    "nevertheless next nine nobody none noone nothing nowhere often one onto others otherwise part per perhaps "
    "please put rather see seem seemed seeming seems serious several show side since sincere six sixty somehow "
    "someone something sometime sometimes somewhere still system take ten thence thereafter thereby therefore "
    "therein thereupon thick thin third though three throughout thru thus together top toward towards twelve "
    "twenty two un upon us via well whatever whence whenever whereafter whereas whereby wherein whereupon "
    "wherever whether whither whoever whole whose within without would yet"
).split()
RELEVANCE_STOP_WORDS = [w for w in STOP_WORDS if "'" not in w and w not in NOT_FOR_RELEVANCE] + MORE_FOR_RELEVANCE
OVERALL_WEIGHTS = {
    "relevance": 0.25, "factual_accuracy": 0.25, "coherence": 0.20, "completeness": 0.15,
    "token_efficiency": 0.10, "time_efficiency": 0.05,
}
KEYWORDS = {
    "retail": ("sales", "customer", "inventory", "store"),
    "finance": ("risk", "investment", "compliance", "market"),
    "healthcare": ("patient", "compliance", "care", "HIPAA"),
}
MIN_KEYWORD_SCORE = 0.2
# --------------------------------------------------------------------------------


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, also inside nested lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def strip(text: str | Column) -> Column:
    return F.btrim(col(text), F.lit(SPACES))


def words(text: str | Column) -> Column:
    return F.filter(F.split(col(text), SPACE_RUN), lambda w: w != "")


def word_count(text: str | Column) -> Column:
    return F.size(words(text))


def sentences(text: str | Column) -> Column:
    return F.filter(F.transform(F.split(col(text), r"\."), strip), lambda s: s != "")


def contains_count(text: str | Column, phrases: Sequence[str]) -> Column:
    """How many of the phrases occur anywhere in the text."""
    total = F.lit(0)
    for phrase in phrases:
        total = total + F.when(F.contains(col(text), F.lit(phrase)), 1).otherwise(0)
    return total


def terms(text: str | Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-case word tokens without stop words, then the bigrams of what is left."""
    tokens = F.filter(
        F.regexp_extract_all(F.lower(col(text)), F.lit(WORD_TOKEN), 0), lambda w: ~w.isin(*stop_words)
    )

    def with_bigrams(t: Column) -> Column:
        pairs = F.greatest(F.size(t) - 1, F.lit(0))
        bigrams = F.zip_with(F.slice(t, 1, pairs), F.slice(t, 2, pairs), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.concat(t, bigrams)

    return let(tokens, with_bigrams)


def facts(text: str | Column) -> Column:
    """Numbers, years, amounts, capitalised phrases and sentences with a verb of being."""
    found = [F.regexp_extract_all(col(text), F.lit("(?U)" + p), 0) for p in FACT_PATTERNS]
    stated = F.filter(sentences(text), lambda s: F.lower(s).rlike("|".join(FACT_VERBS)))
    return F.array_distinct(F.concat(*found, stated))


def fact_f1(response: str | Column, truth: str | Column) -> Column:
    def f1(both: Column) -> Column:
        shared = F.size(F.array_intersect(both["said"], both["true"]))
        # 2pr / (p + r) with p = shared/said and r = shared/true
        return F.when(shared > 0, 2 * shared / (F.size(both["said"]) + F.size(both["true"]))).otherwise(0.0)

    return let(F.struct(facts(response).alias("said"), facts(truth).alias("true")), f1)


def token_efficiency(response, tokens, query) -> Column:
    gained = (word_count(response) - word_count(query)) / col(tokens)
    return F.when(col(tokens) == 0, 0.0).otherwise(
        F.least(F.greatest(gained / 0.5, F.lit(0.0)), F.lit(1.0))
    )


def time_efficiency(ms, length) -> Column:
    ok = (col(ms) > 0) & (col(length) > 0)
    return F.when(ok, F.least(col(length) * 1000 / col(ms) / 1000, F.lit(1.0))).otherwise(0.0)


def completeness(response, query) -> Column:
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    both = F.struct(
        F.lower(col(response)).alias("low"), F.array_except(words(F.lower(col(query))), stop).alias("asked")
    )

    def score(x: Column) -> Column:
        asked = F.size(x["asked"])
        met = F.size(F.filter(x["asked"], lambda w: F.contains(x["low"], w)))
        covered = (
            0.5 * met / asked
            + 0.3 * F.least(word_count(response) / 10, F.lit(1.0))
            + 0.2 * F.when(contains_count(x["low"], CONCLUSIONS) > 0, 1.0).otherwise(0.5)
        )
        return F.when(asked == 0, 1.0).otherwise(covered)

    return let(both, score)


def connector_score(response) -> Column:
    return F.least(contains_count(F.lower(col(response)), CONNECTORS) / 3, F.lit(1.0))


def keyword_relevance(response, domain, keywords=KEYWORDS, floor: float = MIN_KEYWORD_SCORE) -> Column:
    """Share of the domain's keywords present as whole words, with a floor."""
    chain = F.lit(0.0)
    for name, listed in keywords.items():
        hits = F.lit(0)
        for word in listed:
            hits = hits + F.when(col(response).rlike(rf"(?iU)\b{word}\b"), 1).otherwise(0)
        chain = F.when(col(domain) == name, F.greatest(hits / len(listed), F.lit(floor))).otherwise(chain)
    return chain


def token_overlap(response, truth, threshold: float = 0.7) -> Column:
    said = words(F.lower(col(response)))

    def share(wanted: Column) -> Column:
        return F.size(F.array_intersect(wanted, said)) / F.greatest(F.size(wanted), F.lit(1))

    match = let(F.array_distinct(words(F.lower(col(truth)))), share)
    return let(match, lambda m: F.when(m >= threshold, 1.0).otherwise(m))


def exact_match(response, truth) -> Column:
    return F.when(strip(response) == strip(truth), 1.0).otherwise(0.0)


def length_coherence(response, low: int = 10, high: int = 200, short: float = 0.5, long: float = 0.5) -> Column:
    n = word_count(response)
    return F.when(n < low, short).when(n > high, long).otherwise(1.0)


def shape(response) -> dict[str, Column]:
    n_words, n_sentences = word_count(response), F.size(sentences(response))
    has_code = F.contains(col(response), F.lit("```"))
    score = n_words / 100 * 0.5 + n_sentences / 10 * 0.3 + F.when(has_code, 0.2).otherwise(0.0)
    return {
        "word_count": n_words,
        "sentence_count": n_sentences,
        "character_count": F.length(col(response)),
        "has_code_blocks": has_code,
        "has_bullet_points": col(response).rlike(r"(?m)^\s*(•|-|\*|1\.|2\.)"),
        "structure_score": F.least(score, F.lit(1.0)),
    }


def context_quality(context) -> Column:
    def variety(w: Column) -> Column:
        return F.when(F.size(w) > 0, F.size(F.array_distinct(w)) / F.size(w)).otherwise(0.0)

    length = F.length(col(context))
    return F.when(length == 0, 0.0).otherwise(
        (F.least(length / 1000, F.lit(1.0)) + let(words(context), variety)) / 2
    )


def preview(text, n: int) -> Column:
    return F.when(F.length(col(text)) > n, F.concat(F.substring(col(text), 1, n), F.lit("..."))).otherwise(col(text))


# fixed values: keyword families, first match wins
GUIDANCE = (
    (("trend", "pattern", "over time", "seasonal"), "long",
     ("Temporal analysis and trend identification", "Seasonal pattern detection", "Growth rate calculations")),
    (("compare", "difference", "versus", "vs"), "medium",
     ("Comparative analysis between groups", "Statistical significance testing", "Effect size calculations")),
    (("top", "best", "highest", "most"), "medium",
     ("Ranking and prioritization", "Performance benchmarking", "Market share analysis")),
    (("risk", "volatility", "uncertainty"), "long",
     ("Risk factor identification", "Volatility analysis", "Confidence interval calculations")),
    (("customer", "user", "demographic"), "medium",
     ("Customer segmentation analysis", "Demographic profiling", "Behavioral pattern identification")),
)
REQUIREMENTS = {
    "retail": ("Product category analysis", "Sales performance metrics", "Customer behavior patterns"),
    "finance": ("Financial performance indicators", "Risk assessment metrics", "Market trend analysis"),
}


def guidance(query) -> Column:
    """struct(expected_length, focus) chosen by the first keyword family found in the query."""
    lowered = F.lower(col(query))
    nothing = F.array().cast("array<string>")
    chosen = F.struct(F.lit("medium").alias("expected_length"), nothing.alias("focus"))
    for keys, length, focus in reversed(GUIDANCE):
        item = F.struct(
            F.lit(length).alias("expected_length"), F.array(*[F.lit(x) for x in focus]).alias("focus")
        )
        chosen = F.when(contains_count(lowered, keys) > 0, item).otherwise(chosen)
    return chosen


def requirements(question_id) -> Column:
    chosen = F.array().cast("array<string>")
    for prefix, needs in REQUIREMENTS.items():
        listed = F.array(*[F.lit(x) for x in needs])
        chosen = F.when(F.startswith(col(question_id), F.lit(prefix)), listed).otherwise(chosen)
    return chosen


def display_name(name) -> Column:
    return F.initcap(F.replace(col(name), F.lit("_"), F.lit(" ")))
