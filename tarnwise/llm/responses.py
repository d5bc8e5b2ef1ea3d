"""Broken prompt and response pairs.

A response is cut into clauses; a conditional random field tags each as answer,
refusal, echo, foreign or unfinished; the share of the response each tag covers makes
the pair's defect. The field is trained here on sequences built from a bounded sample
of the table's own questions and references (echoes, cuts and exchanged languages are
made from them) and from fixed refusal phrases. What the corpus says about last words
covers all rows.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwise.llm.crf import Crf
from tarnwise.llm.truncation import longer_copies
from tarnwise.session import cut_lineage

TAGS = ["answer", "refusal", "echo", "foreign", "unfinished"]
#: Rows the field is trained on; a documented bound, the same at every size.
SAMPLE_ROWS = 1500
#: Probability from which the last clause counts as unfinished.
UNFINISHED = 0.35

# Function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was were be are on for with that this it at by from as an not which what after before here should has have had no or she he they his her their a does did who when than into".split(),
    "es": "el la los las de del y que en es fue un una por para con se no al lo su sin aunque conviene como más este esta hay entre cada durante ante pero son está sobre qué cuál era fueron ingresó".split(),
    "de": "der die das und ist war in den dem des ein eine einer mit von zu auf für nicht als wird wurde werden soll dass im am bei nach wegen es sind auch aber dennoch über hat keine kein gilt sollte weiter was welche man".split(),
    "fr": "le la les de des du et est était un une dans en pour par avec que qui ne pas au aux ce cette sur plus mais il elle sans jusque pendant aucune été on sait dit séjour faut".split(),
    "pt": "o a os as de do da dos das e é foi um uma em no na nos nas por para com que não se ao mais até lá mas são está sem durante pelo pela tratado este esta sobre como".split(),
    "it": "il lo la i gli le di del della dei e è era stato stata un una in nel per con che non si al più ma sono tra da come dopo senza durante questo questa gli proseguire".split(),
}
_WORDS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}
#: Words that no sentence ends with.
_JOINING = frozenset(w for v in _WORDS.values() for w in v) - frozenset("no not non nicht pas it this that here here? him her más plus mehr all".split())
# Patterns of declining, in the languages above.
SPEAKER = re.compile(r"\b(?:i|i'm|i’m|i'd|i've|i'll|me|my|myself|we|our|yo|je|ich|mir|eu|io)\b|\b(?:lo siento|désolé|es tut mir|desculpe|mi dispiace)\b", re.I)
INABILITY = re.compile(
    r"\b(?:can ?not|can['’]t|won['’]t|unable to|not able to|isn['’]t possible|is not possible|not possible|do not feel|don['’]t feel|not comfortable|would rather not|rather not|not be appropriate|inappropriate|must decline|have to decline|decline to|declined?|refuse|prevents?|outside (?:of )?what|not allowed|not permitted|may not (?:answer|discuss|provide)|beyond what|apologi[sz]e|(?:asked|told|instructed|advised|trained|requested) not to|couldn['’]t|not in a position|not qualified|not provide|refrain)\b"
    r"|\bno puedo\b|\bno me es posible\b|\bne peux pas\b|\bne suis pas en mesure\b|\bkann (?:ich )?(?:\w+ )?nicht\b|\bkann leider\b|\bnão posso\b|\bnon posso\b",
    re.I,
)
IMPERSONAL = re.compile(
    r"\brequest (?:declined|refused|denied)\b|\bas an? (?:ai|assistant|language model|automated)\b|\bmy (?:guidelines|policy|policies|instructions)\b|\bconsult (?:a|your) (?:qualified |licensed )?(?:clinician|doctor|physician|professional|care team)\b|\bwithout a clinician\b|\bmatter for your (?:care team|doctor|clinician)\b|\bmedical advice\b|\bnot be appropriate for me\b|\bwhat i (?:may|can|am able to) (?:discuss|answer|say)\b",
    re.I,
)
COURTESY = re.compile(r"^(?:hello|apologies|ask (?:the|your)|thanks?|thank you|sorry|unfortunately|regrettably|is there (?:something|anything) else|please (?:ask|contact|consult|speak|see)|i hope|let me know)\b", re.I)
OTHERS = re.compile(r"\b(?:patient|family|she|he|they|chart|record|sample|mother|father|wife|husband|nurse)\b", re.I)

# Phrases the refusals of the training sequences are put together from.
_OPEN = ["I'm sorry, but", "Regrettably,", "Apologies,", "To be clear,", "Hello.", "Sorry,", "Unfortunately", "Thank you for asking, but", "As an assistant,", "I apologise, but", "", "", ""]
_CORE = [
    "I can't help with that request", "I cannot provide medical advice about a patient", "I am not able to answer clinical questions", "I'm unable to comment on {x}", "I won't be able to go into {x}",
    "it would not be appropriate for me to answer this", "it isn't possible for me to comment on {x}", "I do not feel comfortable answering this", "I must decline to interpret these records",
    "that is a matter for your care team, and I would rather not answer", "this is outside what I may discuss", "my guidelines prevent me from giving patient-specific information", "request declined: content concerns an identifiable patient",
    "I can't assist with questions on {x}", "I have been asked not to give advice on {x}", "I am not in a position to say which drug is right", "request declined", "request refused: the content concerns a patient", "no puedo responder a esa pregunta", "je ne peux pas répondre à cette question", "ich kann diese Frage nicht beantworten", "não posso responder a essa pergunta", "non posso rispondere a questa domanda",
]
_CLOSE = ["Ask the treating team.", "Is there something else you need?", "Please consult a qualified clinician.", "Please ask your care team.", "", "", "", ""]
_THANKS = ["Thank you for asking about {x}.", "Thanks for the question.", "", "", ""]
# Answers that look like refusals or foreign text and are neither.
_PLAIN = [
    "The patient declined {x} on day 4 and signed the form, so it was not given.", "Unable to tolerate {x}, the patient was switched to another drug.", "Not documented in the record.", "The chart does not record a value for {x}.",
    "{x} cannot be given because of the allergy; another drug was used instead.", "The family was unable to attend, and the last result was normal.", "Sorry to note the sample was lost; the repeat draw was normal.",
    "No contraindication is documented in this admission.", "She said 'me duele la cabeza' at intake.", "He refused the injection on day 2.", "Status post {x}, given pro re nata.", "{x}", "No.", "Yes.", "Diagnosis: {x}", "- {x}\n- {x}", "{x}, {x}",
    "Give {x} per os bis in die for 3 days.",
]

_MARKUP = re.compile(r"</?\w+/?>|\*+|`+|\[/?\w+\]|^\W*(?:final |the )?(?:answer|response|a|output|reply)\s*:\W*|^\W*(?:n/a|null|nan)\W*$", re.I)
_END = re.compile(r"[.!?。…][\"'”’»)\]*`_]*$")
_CLAUSE = re.compile(r"(?<=[.!?;])\s+|\n+")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[^\W\d_]+(?:['’][^\W\d_]+)?")


def content(text: str | None) -> str:
    """Text without mark-up, labels and invisible characters; empty when nothing is said."""
    if not text:
        return ""
    x = re.sub(r"[\u200b-\u200f\u2060\ufeff\x00-\x08\x0b-\x1f]", "", text)
    x = _MARKUP.sub(" ", _MARKUP.sub(" ", x).strip())
    return x.strip() if re.search(r"[^\W_]", x) else ""


def clauses(text: str) -> list[str]:
    return [c for c, _ in _parts(text)]


def _parts(text: str) -> list[tuple[str, bool]]:
    """Clauses, and whether each begins in the middle of a line."""
    out, at = [], 0
    inner = False
    for m in [*_CLAUSE.finditer(text), None]:
        c = text[at : m.start() if m else len(text)].strip()
        if c:
            out.append((c, inner))
        if m:
            inner = "\n" not in m.group(0)
            at = m.end()
    return out


def language(tokens: list[str]) -> dict[str, float]:
    """Share of function words of each language."""
    n = max(1, len(tokens))
    return {k: sum(t in w for t in tokens) / n for k, w in _WORDS.items()}


def _last_word(text: str) -> str:
    found = re.findall(r"[^\W\d_]+", text.lower())
    return found[-1] if found else ""


def featurise(question: str, reference: str, text: str, ends: float, partial: float) -> tuple[list[str], np.ndarray]:
    """Clauses of a response and their feature rows. `ends`: how often the last word ends a text or clause elsewhere; `partial`: 1 if it is the beginning of a commoner word."""
    split = _parts(text)
    parts = [c for c, _ in split]
    q_tokens = [t.lower() for t in _TOKEN.findall(question or "")]
    q_pairs = set(zip(q_tokens, q_tokens[1:]))
    q_set = set(q_tokens)
    q_lang = language(q_tokens)
    own = max(q_lang, key=lambda k: (q_lang[k], k == "en")) if any(q_lang.values()) else "en"
    squeeze = lambda s: re.sub(r"\W+", " ", (s or "").lower()).strip()
    ref, whole = squeeze(reference), squeeze(text)
    prefix = bool(ref) and ref.startswith(whole) and len(whole) < len(ref)
    tail = bool(ref) and len(whole) >= 3 and whole.endswith(ref[-min(25, len(ref)) :])
    rows = []
    for i, c in enumerate(parts):
        tokens = [t.lower() for t in _TOKEN.findall(c)]
        n = max(1, len(tokens))
        pairs = list(zip(tokens, tokens[1:]))
        back = sum(p in q_pairs for p in pairs) / len(pairs) if pairs else float(bool(tokens) and tokens[0] in q_set and n == len(q_tokens))
        if re.match(r"^(?:you asked|question|q)\s*:", c, re.I):
            back = max(back, sum(t in q_set for t in tokens) / n)
        lang = language(tokens)
        other = max((v for k, v in lang.items() if k != own), default=0.0)
        margin = other - lang[own]
        words = sum(v * n for v in lang.values())
        last = i == len(parts) - 1
        # An answer that ends as the reference does is complete, closing mark or not.
        open_end = last and not _END.search(c) and not tail
        spoken, unable = bool(SPEAKER.search(c)), bool(INABILITY.search(c))
        impersonal = bool(IMPERSONAL.search(c))
        function = lang[own] * n >= 1 or other * n >= 2
        dangling = bool(re.search(r"[,;:(\-–]$", c)) or (bool(tokens) and tokens[-1] in _JOINING and c[-1:].isalpha())
        rows.append(
            [
                1.0, spoken, unable, spoken and unable, impersonal, bool(COURTESY.match(c)), bool(OTHERS.search(c)) and not spoken and not impersonal and margin <= 0,
                back, back > 0.85, max(-0.3, min(0.3, margin)) * 3, margin > 0.08 and other * n >= 2, lang[own] > 0.1,
                open_end, open_end and function, open_end and dangling, open_end and prefix, last and tail,
                open_end and ends < 0.02, open_end and partial > 0, n <= 3, words == 0, open_end and split[i][1],
            ]
        )
    return parts, np.array(rows, dtype=float).reshape(len(parts), N_FEATURES)


N_FEATURES = 22


def training_set(sample: list[tuple[str, str]], ends: dict[str, tuple[float, float]], seed: int = 5) -> list[tuple[np.ndarray, list[int]]]:
    """Tagged sequences made from (question, reference) rows."""
    rnd = random.Random(seed)
    out = []
    spoken = [(q, r, max((s := language([t.lower() for t in _TOKEN.findall(q)])), key=lambda k: (s[k], k == "en"))) for q, r in sample if q and r and r.strip()]
    by_lang: dict[str, list[str]] = {}
    for _, r, lang in spoken:
        by_lang.setdefault(lang, []).append(r)

    def add(q: str, ref: str, pieces: list[tuple[str, str]]) -> None:
        text = " ".join(p for p, _ in pieces if p)
        marks = [tag for p, tag in pieces for _ in clauses(p)]
        word = _last_word(text)
        parts, x = featurise(q, ref, text, *ends.get(word, (0.0, 1.0 if pieces[-1][1] == "unfinished" else 0.0)))
        if len(parts) == len(marks) and parts:
            out.append((x, [TAGS.index(m) for m in marks]))

    # Few rows serve more than once, so the field always sees as many sequences.
    for i in range(max(len(spoken), SAMPLE_ROWS) if spoken else 0):
        q, r, lang = spoken[i % len(spoken)]
        named = [t for t in _TOKEN.findall(r) if len(t) > 4 and t[0].isalpha() and not any(t.lower() in w for w in _WORDS.values())]
        subject = rnd.choice(named or ["fever"])
        kind = rnd.random()
        if kind < 0.2:
            add(q, r, [(r, "answer")])
        elif kind < 0.3:
            add(q, r, [(rnd.choice(_PLAIN).format(x=subject), "answer"), (rnd.choice(_PLAIN[:8]).format(x=subject) if rnd.random() < 0.4 else "", "answer")])
        elif kind < 0.5 and len(r) > 20:
            base = r if rnd.random() < 0.6 else " ".join(rnd.choice(_PLAIN[:10]).format(x=subject) for _ in range(2))
            at = rnd.randint(8, len(base) - 4)
            if rnd.random() < 0.3 and len(clauses(base)) > 1:  # just after a clause began
                at = base.rindex(clauses(base)[-1]) + rnd.randint(2, 9)
            cut = base[:at].rstrip()
            head = clauses(cut)
            if not _END.search(cut):
                add(q, r, [(" ".join(head[:-1]), "answer"), (head[-1], "unfinished")])
        elif kind < 0.65:
            pre = rnd.choice(["", "", "", "You asked: ", "Question: "])
            add(q, r, [(pre + q, "echo"), (q if rnd.random() < 0.2 else "", "echo")])
        elif kind < 0.72:
            add(q, r, [(q, "echo"), (r, "answer")])
        elif kind < 0.87:
            core = (rnd.choice(_OPEN) + " " + rnd.choice(_CORE).format(x=subject)).strip()
            add(q, r, [(rnd.choice(_THANKS).format(x=subject), "refusal"), (core[0].upper() + core[1:] + ".", "refusal"), (rnd.choice(_CLOSE), "refusal")])
        else:
            others = [k for k in by_lang if k != lang]
            if others:
                add(q, r, [(rnd.choice(by_lang[rnd.choice(others)]), "foreign")])
    return out


def train(sample: list[tuple[str, str]], ends: dict[str, tuple[float, float]]) -> Crf:
    """A field trained on the sequences of a sample and, at every size, of fixed question and answer pairs, which carry it where the sample is small."""
    base = [("What is the main finding of this admission?", "The main finding of this admission was anaemia, and iron was given."), ("¿Qué se sabe del ingreso de este paciente?", "El paciente ingresó por fiebre y se mantuvo el tratamiento.")]
    sequences = training_set([*sample, *base], ends)
    t = max(len(y) for _, y in sequences)
    x, y, mask = np.zeros((len(sequences), t, N_FEATURES)), np.zeros((len(sequences), t), int), np.zeros((len(sequences), t), bool)
    for i, (a, b) in enumerate(sequences):
        x[i, : len(b)], y[i, : len(b)], mask[i, : len(b)] = a, b, True
    return Crf(N_FEATURES, len(TAGS)).fit(x, y, mask)


def defect(parts: list[str], prob: np.ndarray, empty: bool) -> str | None:
    """The defect a response's clause coverage makes, or None."""
    if empty:
        return "empty"
    size = np.array([max(1, len(p)) for p in parts], float)
    best = prob.argmax(1)
    cover = {t: float(size[best == i].sum() / size.sum()) for i, t in enumerate(TAGS)}
    if cover["echo"] > 0.9:
        return "question_copy"
    if cover["refusal"] >= 0.5:
        return "refusal"
    if cover["foreign"] >= 0.5:
        return "wrong_language"
    if prob[-1, TAGS.index("unfinished")] >= UNFINISHED:
        return "truncated"
    return None


def last_words(rows: DataFrame) -> DataFrame:
    """(word, ends, partial) over all texts: how often a word stands before a closing mark, and whether far commoner words begin with it.
    A word of many texts must be rarer among them by another ten times, since few texts are cut at one place.

    `rows`: text. Counts combine map-side; copies count once, and words meet longer ones by hashes of their beginnings, whatever their length.
    """
    marked = F.regexp_replace(F.lower("text"), r"([^\p{L}\s]|^\s*|\s*$)+", " | ")
    tokens = rows.select("text").distinct().select(F.split(F.concat(marked, F.lit(" | ")), r"\s+").alias("w"))
    pairs = tokens.select(F.explode(F.expr("transform(sequence(0, greatest(size(w) - 2, 0)), i -> named_struct('word', w[i], 'end', if(w[i + 1] = '|', 1, 0)))")).alias("p"))
    counts = pairs.select("p.word", "p.end").filter(F.col("word").rlike(r"^\p{L}+$")).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("end").alias("e"))
    counts = cut_lineage(counts)
    longer = longer_copies(counts.select(F.col("word").alias("value")), counts.select(F.col("word").alias("value"), "n")).toDF("word", "m")
    return counts.join(longer, "word", "left").select("word", (F.col("e") / F.col("n")).alias("ends"), ((F.coalesce("m", F.lit(0)) > 20 * F.col("n")) & (F.coalesce("m", F.lit(0)) > 200 * (F.col("n") - 1))).cast("double").alias("partial"))


def find_defects(rows: DataFrame) -> DataFrame:
    """(id, defect) of each defective row; `rows`: id, question, reference, answer.

    Any column may be null: a null answer is `empty`, a null question has no language but
    English and no echo, a null reference gives no evidence. One defect a row: empty,
    then question_copy, refusal, wrong_language, truncated. Rows alike are judged alike.
    The sample of SAMPLE_ROWS rows is the one with the least hashes of its texts, so it
    does not depend on partitions.
    """
    words = cut_lineage(last_words(rows.select(F.explode(F.array("question", "reference", "answer")).alias("text")).filter("text is not null")))
    distinct = rows.select("question", "reference").filter("question is not null and reference is not null").distinct()
    sample = [(r[0], r[1]) for r in distinct.orderBy(F.xxhash64("question", "reference"), "question", "reference").limit(SAMPLE_ROWS).collect()]
    wanted = sorted({_last_word(r) for _, r in sample})
    spark = rows.sparkSession
    known = spark.createDataFrame([(w,) for w in wanted] or [("",)], "word string")
    ends = {r["word"]: (r["ends"], r["partial"]) for r in words.join(F.broadcast(known), "word").collect()}
    model = train(sample, ends)

    last = F.element_at(F.expr("regexp_extract_all(lower(answer), '(\\\\p{L}+)', 1)"), -1)
    keyed = rows.withColumn("word", F.when(F.size(F.expr("regexp_extract_all(coalesce(lower(answer), ''), '(\\\\p{L}+)', 1)")) > 0, last))
    joined = keyed.join(words, "word", "left").select("id", "question", "reference", "answer", F.coalesce("ends", F.lit(0.0)).alias("ends"), F.coalesce("partial", F.lit(0.0)).alias("partial"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), 1000):
                pdf = whole.iloc[at : at + 1000]
                found, todo = [], []
                for i, q, r, a, e, p in pdf[["id", "question", "reference", "answer", "ends", "partial"]].itertuples(index=False):
                    text = content(a)
                    if not text:
                        found.append((i, "empty"))
                        continue
                    parts, x = featurise(q or "", r or "", text, e, p)
                    todo.append((i, parts, x))
                # Sequences of like length go through the field together, so one very long text does not pad the rest.
                todo.sort(key=lambda s: len(s[1]))
                for k in range(0, len(todo), 250):
                    some = todo[k : k + 250]
                    t = max(len(s[1]) for s in some)
                    x, mask = np.zeros((len(some), t, N_FEATURES)), np.zeros((len(some), t), bool)
                    for j, (_, parts, f) in enumerate(some):
                        x[j, : len(parts)], mask[j, : len(parts)] = f, True
                    prob = model.posteriors(x, mask)
                    for j, (i, parts, _) in enumerate(some):
                        if d := defect(parts, prob[j, : len(parts)], False):
                            found.append((i, d))
                yield pd.DataFrame(found, columns=["id", "defect"])

    return joined.mapInPandas(run, f"id {id_type}, defect string")
