"""Problem 3: defective answers in prompt and response pairs.

A character n-gram naive Bayes model gives the language posteriors of prompt and response,
sentence by sentence; prose that is not in the prompt's language is a defect. Another one tells
clauses that decline from such of analysis. Truncation shows
in the end-of-text likelihood: how often the corpus ends a text after the last characters of
this one, by n-grams of one to six characters, each backing off to the shorter one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegrain.session import materialize
from codegrain.sources.tables import join_groups

# What stands where an answer should be.
PLACEHOLDERS = set(
    "n a|na|none|null|nil|nan|todo|to do|tbd|fixme|xxx|empty|blank|unknown|undefined|unspecified|missing|pending|placeholder|void|idk|error|failed|"
    "no answer|no analysis|no response|no output|no content|no explanation|no data|no result|not available|not applicable|not provided|not known|not given|"
    "to be done|to be determined|to be added|lorem ipsum|see above".split("|")
)
LABELS = set("root cause|safety justification|analysis|answer|the answer|here is the answer|explanation|justification|response|result|output|reason|cause|summary|question|c|cpp|json|text|markdown".split("|"))
SENTINEL = re.compile(r"^\W*\[\s*(?:analysis failed|skipped\b[^\]]*|failed\b[^\]]*|error\b[^\]]*|no answer|empty|timeout\b[^\]]*|context overflow|generation failed)\s*\]\W*$", re.I)

#: A whole answer in one pair of brackets without a sentence is a sentinel too.
BRACKETED = re.compile(r"\W*[\[<{(][^\[\]<>{}().!?。]*[\]>})]\W*")

# Sentences that decline, and such as go with them; the refusal model learns from these and from the answers of the corpus.
DECLINING = """
I cannot help with this request
I can't help with that
I can not assist with this
I won't answer this question
I will not provide an explanation
I am unable to comply
I'm unable to answer this
I am not able to discuss this
I don't feel able to answer this
I do not feel comfortable answering
I'm not comfortable explaining this
I would rather not go into this
I'd rather not describe it
I would prefer not to answer
I must decline to answer
I have to decline this request
I respectfully decline
I refuse to answer this
I am not allowed to comment on this
I am not permitted to share such details
I cannot comply with the instructions
I can't provide any details about it
I can't talk about vulnerabilities
I can't do that
I could not in good conscience explain this
That is something I can't do
That is not something I can help with
This is not something I am able to discuss
Answering this would not be appropriate
It would be inappropriate for me to explain
It would not be right for me to describe this
It would be irresponsible to explain how to exploit it
Helping with this is not possible
Helping with that isn't possible here
No answer can be given to this request
No explanation will be provided
No details will be shared
This request is beyond what I can do
This question is outside the scope of what I may answer
This request goes against my guidelines
My guidelines do not permit me to answer
My instructions prevent me from discussing this
My policy does not allow me to help
Our rules forbid sharing such information
Explaining this could cause harm
Describing this could enable misuse
Such information could be misused and I will not give it
As an AI language model I cannot analyse this
As an assistant I am not able to review this code
The request has to be refused
I am going to pass on this one
I'm afraid I can't answer
I was asked not to talk about such matters
Nothing can be said about this
No comment
This is a topic I stay away from
"""
COURTEOUS = """
Sorry
I apologize
Sorry about that
I'm sorry but
Unfortunately
Thank you for the question
Thanks for sharing the code
Thanks for your understanding
Please ask a professional
Please consult an expert
Please contact the maintainers
Consider asking somebody else
Consider contacting the authors
Let me know if there is something else
Let me know if you need anything else
If you have another question I am glad to help
Feel free to ask another question
I am happy to help with other questions
I hope you understand
Is there anything else I can help you with
I need to be cautious
As an assistant
As it might do harm
Thank you
However
"""

# Languages of the model by their codes; code is one more class.
CODE = {"c": "code", "cpp": "code"}

SPAN = re.compile(r"```.*?(?:```|$)|`[^`\n]*`?|\"[^\"\n]{0,400}\"|“[^”\n]{0,400}”|«[^»\n]{0,400}»|「[^」\n]{0,400}」", re.S)
# No match begins within a word, so none is looked for there.
IDENTIFIER = re.compile(r"(?!\B\w)(?:\w*(?:[a-z][A-Z]|[_\d])\w*|\w+\([^)\n]*\)|[\w.]*(?:->|::)\w*|\w*/[\w/.]*)", re.A)
SENTENCE = re.compile(r"[^.!?。！？\n]+")
CLAUSE = re.compile(r"[^.!?。！？\n,;:]+")
NOT_WORD = re.compile(r"[^\w']+")
NOT_LETTERS = re.compile(r"[\W\d_]+")
NOT_ALNUM = re.compile(r"[\W_]+")
TICKED = re.compile(r"`[^`\n]*`?")
WORD_CHARACTER = re.compile(r"\w")
SHINGLE = 12
ORDER = 6


def content(answer: str) -> str:
    return " ".join(NOT_ALNUM.sub(" ", answer.lower()).split())


def is_empty(answer: str | None) -> bool:
    """No content: null, blank, a placeholder, a bare label or a failure sentinel."""
    if not answer or SENTINEL.match(answer) or BRACKETED.fullmatch(answer):
        return True
    text = content(answer)
    while text and text not in PLACEHOLDERS and text not in LABELS:
        label = next((x for x in LABELS if text.startswith(x + " ")), None)
        if label is None:
            return False
        text = text[len(label) + 1:]
    return True


def asked_text(texts: list[str | None]) -> str:
    """The letters and digits of a question's texts, each text apart from the next."""
    return "\0".join(NOT_ALNUM.sub("", (t or "").lower()) for t in texts)


def is_copy(answer: str, question: str, lead: int = 40, share: float = 0.9) -> bool:
    """After a lead-in of at most ``lead`` letters and digits, ``share`` of the rest is in the question.

    What lies within a run of SHINGLE characters that the question has too counts. The walk ends as
    soon as too much is not in the question.
    """
    a = NOT_ALNUM.sub("", answer.lower())
    if len(a) < SHINGLE:
        return bool(a) and a in question
    starts = len(a) - SHINGLE + 1
    first = next((i for i in range(min(lead, len(a) // 2, starts - 1) + 1) if a[i:i + SHINGLE] in question), None)
    if first is None:
        return False
    allowed = (1 - share) * (len(a) - first)
    lost, end = 0, first
    for i in range(first, starts):
        if a[i:i + SHINGLE] in question:
            lost += max(0, i - end)
            end = i + SHINGLE
        if lost + max(0, i + 1 - end) > allowed:
            return False
    return lost + len(a) - end <= allowed


@lru_cache(16)
def prose(text: str | None) -> str:
    """A text without code, quotations and identifiers."""
    return IDENTIFIER.sub(" ", SPAN.sub(" ", text or ""))


def sentences(text: str | None) -> list[str]:
    """The sentences of a prose, as lower-case letters and blanks."""
    out = (NOT_LETTERS.sub(" ", s).strip().lower() for s in SENTENCE.findall(text or ""))
    return [s for s in out if s]


def clauses(text: str) -> list[str]:
    """The clauses of a prose, as lower-case words."""
    out = (NOT_WORD.sub(" ", s).strip().lower() for s in CLAUSE.findall(text.replace("’", "'")))
    return [s for s in out if s]


def grams(sentence: str) -> list[str]:
    s = f" {sentence} "
    return [*sentence.replace(" ", ""), *(s[i:i + 2] for i in range(len(s) - 1)), *(s[i:i + 3] for i in range(len(s) - 2))]


def count_grams(pieces: Iterable[str], cut: Callable[[str], list[str]], into: Counter) -> None:
    """Adds the n-grams of all pieces; a piece that comes again is cut once."""
    for s, n in Counter(pieces).items():
        if n == 1:
            into.update(cut(s))
        else:
            for g in cut(s):
                into[g] += n


class Language:
    """Naive Bayes over character n-grams: {language: {gram: count}}; laid out as one table."""

    def __init__(self, counts: dict[str, dict[str, int]], home: str, home_prior: float = 0.99) -> None:
        self.names = sorted(set(counts) | {home})
        self.home = self.names.index(home)
        vocabulary = {g for c in counts.values() for g in c}
        totals = np.array([sum(counts.get(x, {}).values()) for x in self.names], float)
        self.unseen = -np.log(totals + len(vocabulary) + 1)
        self.rows = {g: k for k, g in enumerate(sorted(vocabulary))}
        seen = np.array([[counts.get(x, {}).get(g, 0) for x in self.names] for g in self.rows] + [[0] * len(self.names)], float)
        self.table = np.log(seen + 1) + self.unseen  # the last row is that of unseen n-grams
        self.prior = np.log(np.where(np.arange(len(self.names)) == self.home, home_prior, (1 - home_prior) / max(1, len(self.names) - 1)))

    @lru_cache(1 << 14)  # sentences come again
    def score(self, sentence: str) -> np.ndarray:
        rows, last = self.rows, len(self.rows)
        return self.table[[rows.get(g, last) for g in grams(sentence)]].sum(axis=0) / 3  # n-grams of three orders tell the same thing thrice

    def posterior(self, sentence: str, prior: np.ndarray | None = None) -> np.ndarray:
        score = self.score(sentence) + (0 if prior is None else prior)
        p = np.exp(score - score.max())
        return p / p.sum()

    def mismatch(self, prompt: str | None, answer: str, doubtful: bool = True) -> float:
        """The share of the answer's prose that is, by the posteriors, not in the prompt's language.

        Unless ``doubtful``, the home language is as likely beforehand as it is for a prompt, so short sentences count for it.
        """
        expected = self.prior_of(prompt)
        lost = size = 0.0
        for s in sentences(prose(answer)):
            weight = sum(2 if ord(c) > 0x2E7F else 1 for c in s)
            p = self.posterior(s, None if doubtful else self.prior)
            if "code" in self.names:
                p[self.home] += p[self.names.index("code")]
            lost += weight * (1 - float(p @ expected))
            size += weight
        return lost / size if size else 0.0

    def prior_of(self, prompt: str | None) -> np.ndarray:
        p = self.posterior(" ".join(sentences(prose(prompt))), self.prior) if prompt else np.exp(self.prior)
        if "code" in self.names:
            p[self.home] += p[self.names.index("code")]
        return p


MANNERS = ("analysis", "declining", "courteous")
MANNER_PRIOR = np.log([0.96, 0.02, 0.02])
MANNER_ORDER = 5


def manner_grams(clause: str) -> list[str]:
    s = f" {clause} "
    return [s[i:i + MANNER_ORDER] for i in range(len(s) - MANNER_ORDER + 1)]


class Manner:
    """Naive Bayes over the character n-grams of clauses: whether one analyses, declines or goes with declining.

    N-grams that no class has say nothing, so text of another kind keeps its prior.
    """

    def __init__(self, analysis: dict[str, int]) -> None:
        counts = [Counter(analysis)]
        for told in (DECLINING, COURTEOUS):
            counts.append(Counter(g for line in told.split("\n") for c in clauses(line) for g in manner_grams(c)))
        vocabulary = sorted({g for c in counts for g in c})
        self.rows = {g: k for k, g in enumerate(vocabulary)}
        seen = np.array([[c.get(g, 0) for c in counts] for g in vocabulary], float) + 0.5
        self.table = np.log(seen / seen.sum(axis=0)) / 2  # n-grams that overlap tell the same thing again

    @lru_cache(1 << 14)
    def posterior(self, clause: str) -> np.ndarray:
        rows = self.rows
        score = self.table[[rows[g] for g in manner_grams(clause) if g in rows]].sum(axis=0) + MANNER_PRIOR
        p = np.exp(score - score.max())
        return p / p.sum()

    def refuses(self, answer: str) -> bool:
        """Declines, and more than half of the prose is of that kind; read until half of it is known to be analysis."""
        said = clauses(prose(answer))
        total, analysis, declines = sum(map(len, said)), 0.0, False
        for c in said:
            p = self.posterior(c)
            analysis += len(c) * float(p[0])
            if 2 * analysis >= total:
                return False
            declines = declines or p[1] > 0.5
        return declines


MOST_COUNTED = 500_000  # n-grams that a task holds before it gives partial sums, which the shuffle adds up


def fit_manner(df: DataFrame, key: str, answers: list[str], most_grams: int = 50_000) -> Manner:
    """A refusal model from the sentences above and the answers of all rows with a key.

    That a few answers are refusals themselves does not matter. The ``most_grams`` most
    frequent n-grams go through the driver.
    """
    texts = df.where(F.col(key).isNotNull()).select(F.explode(F.array(*answers)).alias("t")).where("t is not null")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: Counter = Counter()

        def out() -> pd.DataFrame:
            return pd.DataFrame({"gram": list(total), "n": list(total.values())}).astype({"gram": object, "n": "int64"})

        for b in batches:
            count_grams((c for t in b["t"] for c in clauses(prose(t))), manner_grams, total)
            if len(total) > MOST_COUNTED:
                yield out()
                total.clear()
        yield out()

    total = texts.mapInPandas(count, T.StructType().add("gram", "string").add("n", "long")).groupBy("gram").agg(F.sum("n").alias("n"))
    return Manner({r["gram"]: r["n"] for r in total.orderBy(F.desc("n"), "gram").limit(most_grams).collect()})


def fit_language(df: DataFrame, key: str, text: str, lang: str, home: str, grams_per_language: int = 8_000, most_languages: int = 200, least_rows: int = 5) -> Language:
    """A language model from labelled texts.

    Fitted on all labelled rows with a key; the ``grams_per_language`` most frequent n-grams of each
    language make up the model, so what the driver collects is bounded whatever the size of the table. Labels are trimmed and lower-cased; wrong
    ones are outvoted. Labels of under ``least_rows`` rows are left out, and, of more than
    ``most_languages``, the rarest.
    """
    label = F.lower(F.trim(F.col(lang)))
    rows = df.where(F.col(key).isNotNull() & F.col(text).isNotNull() & label.rlike("^[a-z][a-z0-9+#_-]*$") & (label != "und")).select(F.col(text).alias("t"), label.alias("lang"))
    labels = rows.groupBy("lang").agg(F.count("*").alias("rows")).where(F.col("rows") >= least_rows).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()
    picked = rows.where(F.col("lang").isin([r["lang"] for r in labels]))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}

        def out() -> pd.DataFrame:
            return pd.DataFrame([(x, g, n) for x, c in counts.items() for g, n in c.items()], columns=["lang", "gram", "n"])

        for b in batches:
            for x, texts in b["t"].groupby(b["lang"].map(lambda x: CODE.get(x, x))):
                count_grams((s for t in texts for s in sentences(prose(t))), grams, counts.setdefault(x, Counter()))
            if sum(map(len, counts.values())) > MOST_COUNTED:
                yield out()
                counts.clear()
        yield out()

    total = picked.mapInPandas(count, T.StructType().add("lang", "string").add("gram", "string").add("n", "long")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= grams_per_language)
    counts: dict[str, dict[str, int]] = {}
    for r in top.select("lang", "gram", "n").collect():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Language(counts, home)


def ending(answer: str) -> str:
    """A text as the end-of-text model sees it: lower case, digits and code in ticks made alike."""
    text = TICKED.sub(lambda m: WORD_CHARACTER.sub("a", m.group()), answer.rstrip().lower())
    return re.sub(r"\d", "0", text)


JUDGED = T.StructType().add("k", "long").add("field", "string").add("defect", "string").add("body", "string")
COUNTED = T.StructType().add("gram", "string").add("n", "long").add("ends", "long")


def end_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How often each n-gram of one to ORDER characters occurs, and how often at the end of a text."""
    n: Counter = Counter()
    ends: Counter = Counter()

    def out() -> pd.DataFrame:
        df = pd.DataFrame({"gram": list(n), "n": list(n.values())})
        df["ends"] = [ends[g] for g in df["gram"]]
        return df.astype({"gram": object, "n": "int64", "ends": "int64"})

    for b in batches:
        for s in b["body"]:
            for k in range(1, ORDER + 1):
                n.update(s[i:i + k] for i in range(len(s) - k + 1))
                if len(s) >= k:
                    ends[s[-k:]] += 1
        if len(n) > MOST_COUNTED:
            yield out()
            n.clear()
            ends.clear()
    yield out()


def end_likelihood(rows: DataFrame, weight: float = 10.0) -> DataFrame:
    """``(tail, likelihood)`` for the distinct last ORDER characters of ``rows.body``.

    P(end | n-gram) for growing n-grams, each smoothed with ``weight`` times the shorter one's. Each distinct
    text counts once and is itself left out of the counts, so that a cut nobody else has made is not its own
    precedent, however many copies it has.
    """
    texts = rows.select("body").distinct()
    counts = texts.mapInPandas(end_counts, COUNTED).groupBy("gram").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    tails = texts.select(F.right("body", F.lit(ORDER)).alias("tail")).distinct()
    parts = tails.select("tail", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("tail")), lambda k: F.right(F.col("tail"), k))).alias("order", "gram"))
    # Many tails share their last character: only the n-grams of tails are kept, with their number of tails.
    needed = materialize(parts.groupBy("gram").agg(F.count("*").alias("tails")).join(counts, "gram"), "p3-grams")
    joined = join_groups(parts, needed, "gram", "tails").groupBy("tail").agg(F.sort_array(F.collect_list(F.struct("order", "n", "ends"))).alias("grams"))
    start = F.lit(0.0)
    likelihood = F.aggregate("grams", start, lambda p, g: (g["ends"] - 1 + weight * p) / (g["n"] - 1 + weight))
    return joined.select("tail", likelihood.alias("likelihood"))


def defects(df: DataFrame, language: Language, manner: Manner, key: str, prompt: str, question: list[str], answers: list[str], order: str, truncated_below: float = 0.04) -> DataFrame:
    """``(key, field_name, defect)`` for each defective answer.

    Of several defects the first in this order is given: empty, copy, refusal, other_language,
    truncated. A text that declines in another language is other_language. Null answers are empty. Null or empty questions can't be copied from, a null
    prompt counts as one in the home language. Rows with a null key are left out, re-deliveries
    reduced to the last by ``order``; other columns are ignored. The end-of-text model is counted
    over the distinct answers without another defect.
    """
    model = df.sparkSession.sparkContext.broadcast((language, manner))
    columns = list(dict.fromkeys([prompt, *question, *answers]))
    names = [f"c{i}" for i in range(len(columns))]
    at = dict(zip(columns, names))
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(order), F.lit("1000-01-01").cast("timestamp")).alias("o"), *[F.col(c).alias(n) for c, n in at.items()])
    last = rows.groupBy("k").agg(F.max_by(F.struct(*names), "o").alias("r")).select("k", "r.*")

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lang, manner = model.value
        for b in batches:
            out = []
            for row in b.to_dict("records"):
                asked: str | None = None
                for f in answers:
                    s, verdict = row[at[f]], None
                    if is_empty(s):
                        verdict = "empty"
                    else:
                        if asked is None:
                            asked = asked_text([row[at[q]] for q in question])
                        if is_copy(s, asked):
                            verdict = "copy"
                        elif manner.refuses(s) and lang.mismatch(row[at[prompt]], s, doubtful=False) <= 0.5:
                            verdict = "refusal"
                        elif lang.mismatch(row[at[prompt]], s) > 0.5:
                            verdict = "other_language"
                    out.append((row["k"], f, verdict, None if verdict else ending(s)))
            yield pd.DataFrame(out, columns=JUDGED.names).astype({"defect": object, "body": object})

    judged = materialize(last.mapInPandas(judge, JUDGED), "p3-judged")
    open_ = judged.where("defect is null")
    cut = end_likelihood(open_).where(F.col("likelihood") < truncated_below).select("tail")
    truncated = open_.withColumn("tail", F.right("body", F.lit(ORDER))).join(cut, "tail").select("k", "field", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("k", "field", "defect").unionByName(truncated).select(F.col("k").alias(key), F.col("field").alias("field_name"), "defect")
