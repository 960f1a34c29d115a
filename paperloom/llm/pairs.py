"""Defective answers: a multi-label linear classifier on hashed n-grams and pair features.

It is fitted on answers of the input made defective here (emptied, refused, truncated, copied,
swapped with another language), with thresholds calibrated on held-out ones of them.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm.words import words
from paperloom.runtime import map_rows

LABELS = ("empty_answer", "refusal", "truncated_answer", "copied_question", "other_language")
#: Hash buckets of the model; rows of the bounded training sample.
BUCKETS, SAMPLE_ROWS = 1 << 16, 3000

#: Frequent function words of the languages.
STOPWORDS = {
    "en": "the of and in to a is that for on with as are by was were be this from which or an at not but have it their than only when what does how why between more did do such if would will you".split(),
    "de": "der die das und in den von zu mit ist im für auf des dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so zum war haben nur oder aber vor zur bis mehr durch kann sich ob wenn weil welche was falls kaum laut".split(),
    "fr": "le la les de des du et en un une dans est que qui pour par sur au aux avec ne pas ce se sont plus il elle ou mais leur cette ces été être selon si comme entre dont sans après quel quelle lors chez surtout notamment".split(),
    "es": "el la los las de del y en un una que es por con para al se no lo como más su sus pero o este esta entre cuando según sobre también sin muy qué si fue son ha hay desde hasta cada tiene nota papel".split(),
}
#: Answers that say nothing.
PLACEHOLDERS = ["", " ", "\t", "\n", "​", "N/A", "n/a", "n.a.", "NA", "-", "--", "---", "—", "–", "...", "…", ".", "?", "null", "NULL", "none", "None", "nil", "nan", "NaN", "[]", "{}", "()", "\"\"", "''", "<no answer>", "<empty>", "<none>", "[no answer]", "[empty]", "(empty)", "(no answer)", "no answer", "No answer.", "Answer:", "A:", "Antwort:", "Réponse :", "Respuesta:", "TBD", "TODO", "tbd", "to do", "undefined", "blank", "empty", "unknown", "keine Angabe", "k.A.", "k. A.", "sans réponse", "sin respuesta", "keine Antwort", "s/o", "xxx", "_", "*", "#", "\\n", "<answer>", "</answer>", "<answer></answer>", "[answer]", "[placeholder]", "Lorem ipsum"]
#: Declining answers; {x} stands for a phrase of the question.
REFUSALS = {
    "en": ["I cannot answer this question.", "I can't help with that.", "I'm sorry, but I cannot answer this.", "I'm sorry, but I am not able to answer this.", "Sorry - this request is outside what I can help with.", "Sorry, I am unable to help with this request.", "I don't know.", "I do not know the answer.", "No comment.", "I have no information on {x}.", "I cannot find enough information in the provided sources.", "The provided sources do not contain enough information to answer.", "The context does not allow me to say anything about that.", "The context does not mention {x}, so I cannot answer.", "Insufficient context.", "Not enough context to answer.", "There is no information about {x} in the passages.", "Unfortunately there is nothing in the passages I could use, so I will not guess.", "Unfortunately, I cannot say anything about {x}.", "None of the retrieved chunks deals with {x}, therefore I have to leave the question open.", "None of the sources covers {x}; I must leave this unanswered.", "It is not possible for me to judge {x} from what was retrieved.", "I would rather not speculate; please consult {x}.", "I would rather not comment on {x}.", "I prefer not to answer.", "As an assistant I must decline to comment on {x}.", "As an AI language model, I cannot give an opinion on {x}.", "My instructions forbid statements on {x}.", "My guidelines do not permit me to discuss {x}.", "Regrettably, {x} is a subject I am unable to discuss.", "I must decline to answer questions about {x}.", "I am not allowed to talk about {x}.", "This is beyond my knowledge.", "I am afraid I cannot help here.", "Please ask an expert about {x}; I can't answer.", "That question is outside my scope.", "I won't answer this question.", "The documents give me no basis for an answer.", "Could you rephrase? I have nothing to offer about {x}.", "Could you clarify what you mean by {x}? I cannot tell from these passages.", "With these passages I have nothing to say about {x}.", "Nothing in the sources helps with {x}.", "I have to pass on this one.", "I am not in a position to judge {x}.", "It would be irresponsible to comment on {x} here.", "The passages are silent on {x}.", "Let us talk about something else.", "This topic is not something I can discuss.", "No answer can be given to this from the material.", "No reply can be given on this basis about {x}.", "Any statement on {x} would be made up.", "I was given nothing about {x}; please supply more material."],
    "de": ["Tut mir leid, diese Frage kann ich nicht beantworten.", "Diese Frage kann ich leider nicht beantworten.", "Dazu kann ich nichts sagen.", "Ich weiß es nicht.", "Kein Kommentar.", "Die Auszüge reichen für eine Antwort nicht aus.", "Die vorliegenden Quellen enthalten dazu keine Angaben.", "Zu {x} möchte ich mich nicht äußern.", "Ich möchte mich dazu lieber nicht äußern.", "Leider finde ich in den Quellen nicht genug Informationen.", "Der Kontext lässt keine Aussage zu {x} zu.", "Als Assistent darf ich dazu keine Auskunft geben.", "Ohne weitere Angaben kann ich keine Antwort geben.", "Ich bin nicht in der Lage, das zu beurteilen."],
    "fr": ["Je suis désolé, je ne peux pas répondre à cette question.", "Je ne peux pas répondre à cette question.", "Je ne sais pas.", "Sans commentaire.", "Les extraits fournis ne me permettent pas de répondre.", "Les sources fournies ne contiennent pas assez d'informations.", "Je préfère ne pas me prononcer sur ce point.", "Je préfère ne pas répondre.", "Désolé, cette demande dépasse ce que je peux faire.", "Le contexte ne permet pas de juger {x}.", "Je ne suis pas en mesure de vous aider.", "Malheureusement, je ne trouve rien sur {x} dans les passages.", "En tant qu'assistant, je dois refuser de commenter {x}."],
    "es": ["Lo siento, no puedo responder a esta pregunta.", "No puedo responder a esta pregunta.", "No lo sé.", "Sin comentarios.", "Los fragmentos disponibles no bastan para responder.", "Las fuentes no contienen suficiente información.", "Prefiero no opinar sobre este asunto.", "Prefiero no responder.", "Lamentablemente no encuentro nada sobre {x} en los pasajes.", "El contexto no permite decir nada sobre {x}.", "Como asistente debo abstenerme de comentar {x}.", "No estoy en condiciones de ayudar con eso.", "Esa petición queda fuera de lo que puedo hacer."],
}
#: Openings and closings around an answer.
OPENINGS = {"en": ["Hello! ", "Thank you for the question. ", "Based on the sources: ", "Hi. ", "Answer: ", "Unfortunately: ", "Well, "], "de": ["Hallo! ", "Danke für die Frage. ", "Antwort: ", "Guten Tag. "], "fr": ["Bonjour ! ", "Merci pour la question. ", "Réponse : "], "es": ["¡Hola! ", "Gracias por la pregunta. ", "Respuesta: "]}
SOFT = {"en": ["I cannot give exact numbers; still, the direction is clear. ", "Sorry for the long wait. ", "The sources do not settle this fully, but they help. ", "I'm sorry for the delay. ", "I do not know every detail, but the passages say this: ", "Unfortunately the samples were small. ", "I can't be certain, yet the evidence is this. "], "de": ["Genaue Zahlen kann ich nicht nennen, die Richtung ist aber klar. ", "Entschuldigung für die lange Wartezeit. ", "Die Quellen klären das nicht ganz, helfen aber. "], "fr": ["Je ne peux pas donner de chiffres exacts, mais la tendance est claire. ", "Désolé pour l'attente. ", "Les sources ne tranchent pas tout à fait, mais elles aident. "], "es": ["No puedo dar cifras exactas, pero la tendencia es clara. ", "Perdón por la espera. ", "Las fuentes no lo aclaran del todo, pero ayudan. "]}
FRAMES = {"en": ["{q}", "Question: {q}", "The question is: \"{q}\"", "Q: {q}\nA:", "You asked: {q}", "Your question was: {q} Let me restate it. {q}", "{q} {q}", "Thank you for asking: {q}", "{q} (see above)", "> {q}", "\"{q}\" - that is the question.", "So: {q}", "User: {q}\nAssistant:", "Good question: {q}", "So you would like to know: {q}", "If I understand you correctly, you want to know: {q}", "You are asking me the following: {q}", "You want to know: {q}", "To repeat: {q}"], "de": ["{q}", "Frage: {q}", "Sie fragten: {q}", "Die Frage lautet: „{q}“", "{q} {q}", "{q} (siehe oben)"], "fr": ["{q}", "Question : {q}", "Vous demandez : {q}", "La question est : « {q} »", "{q} {q}", "{q} (voir plus haut)"], "es": ["{q}", "Pregunta: {q}", "Usted pregunta: {q}", "La pregunta es: «{q}»", "{q} {q}", "{q} (véase arriba)"]}

_CITE = re.compile(r"(?:\s*[\[(](?:source|sources|quelle|fuente|doc)?\s*[\d., ]+[\])])+\s*$", re.I)
_STOP = re.compile(r"[.!?…。][\"'”’»)\]]*$")
_ABBREVIATION = re.compile(r"(?:\b(?:e\.g|i\.e|etc|cf|vs|al|z\.B|d\.h|bzw|p\.ex|p\. ?ej|Fig|Dr|approx|ca)\.|\.\.\.|…|\b[A-Z]\.)$", re.I)


def language(text: str | None) -> tuple[str | None, float]:
    """The language whose function words prevail, and by how much (0 to 1)."""
    ws = words(text)
    hits = sorted(((sum(w in s for w in ws), name) for name, s in _SETS.items()), reverse=True)
    if not ws or hits[0][0] == 0:
        return None, 0.0
    return hits[0][1], (hits[0][0] - hits[1][0]) / max(1, hits[0][0])


_SETS = {k: frozenset(v) for k, v in STOPWORDS.items()}
_KEPT = frozenset().union(*_SETS.values())


def _level(x: float, steps: tuple[float, ...]) -> int:
    return sum(x > s for s in steps)


def features(question: str | None, answer: str | None) -> list[str]:
    """Names of the pair's features: how the answer ends, how much of it is new, its language
    beside the question's, and n-grams of short answers, of the opening and of the last sentence."""
    a = unicodedata.normalize("NFKC", answer or "")
    a = "".join(c for c in a if unicodedata.category(c) not in ("Cf", "Cc") or c in "\n\t").strip()
    aw, qw = words(a), words(question)
    core = _CITE.sub("", a).rstrip()
    f = ["bias", f"n{_level(len(aw), (0, 1, 2, 3, 5, 8, 12, 18, 25, 40))}"]
    if len(aw) <= 3:
        whole = re.sub(r"\s+", " ", a.lower())
        f += [f"whole={whole}", f"bare={re.sub(r'[\W_]+', '', whole)}", f"letters{int(any(c.isalpha() for c in a))}", f"colon{int(a.endswith(':'))}", f"short{len(aw)}stop{int(bool(_STOP.search(a)))}"]
    # the end
    ended = bool(_STOP.search(core)) and not _ABBREVIATION.search(core) or not aw
    depth = sum(core.count(c) for c in "([") - sum(core.count(c) for c in ")]")
    cut = not ended and len(aw) > 3 and not core.endswith((":", "”", '"'))
    f += [f"ended{int(ended)}", f"depth{min(1, max(0, depth))}", f"cut{int(cut)}long{_level(len(aw), (3, 8))}", f"abbr{int(bool(_ABBREVIATION.search(core)))}"]
    # the question within the answer
    qset, aset = Counter(qw), Counter(aw)
    rest = aset - qset - qset
    new = sum(rest.values())
    covered = sum((aset & qset).values()) / max(1, len(qw))
    f += [f"new{_level(new, (0, 2, 4, 6, 9, 14))}", f"cover{_level(covered, (0.2, 0.5, 0.75, 0.9, 0.98))}", f"newcover{_level(new, (2, 4, 6, 9, 14))}{_level(covered, (0.5, 0.75, 0.9))}", f"copy{int(covered > 0.75 and new <= 8)}"]
    copy = covered > 0.75 and new <= 8
    f += [f"copyended{int(copy)}{int(ended)}"]
    # languages
    (lq, mq), (la, ma) = language(question), language(a)
    differ = lq is not None and la is not None and lq != la
    f += [f"differ{int(differ)}", f"differ{int(differ)}{_level(min(mq, ma), (0.15, 0.3, 0.5))}{_level(len(aw), (3, 8, 15))}"]
    # n-grams, of short answers only, the question's own words masked: what an answer talks about
    # tells nothing of its form
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", core) if s]
    f += [f"sent{min(4, len(sentences))}n{_level(len(aw), (3, 12, 20, 30))}"]
    if len(aw) <= 30:
        aw = ["·" if w in qset and w not in _KEPT else w for w in aw]
        f += [f"a:{w}" for w in set(aw)] + [f"a:{x} {y}" for x, y in zip(aw, aw[1:])] + [f"a:{x} {y} {z}" for x, y, z in zip(aw, aw[1:], aw[2:])]
    return f


def hashed(names: list[str]) -> np.ndarray:
    """Distinct buckets of feature names."""
    return np.unique(np.fromiter((xxhash.xxh3_64_intdigest(n) % BUCKETS for n in names), dtype=np.int64, count=len(names)))


class PairModel:
    """One logistic regression per label over hashed features, with a threshold per label."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def logits(self, x: list[np.ndarray]) -> np.ndarray:
        return np.stack([self.weights[i].sum(axis=0) for i in x]) if x else np.zeros((0, len(LABELS)))

    def decide(self, question: str | None, answer: str | None) -> tuple[str | None, float]:
        """The label furthest above its threshold, with that margin; none if all are below."""
        margin = self.logits([hashed(features(question, answer))])[0] - self.thresholds
        k = int(margin.argmax())
        return (LABELS[k], float(margin[k])) if margin[k] > 0 else (None, float(margin[k]))


def _fit(x: list[np.ndarray], y: np.ndarray, epochs: int = 8, rate: float = 0.3, decay: float = 2e-4, seed: int = 3) -> np.ndarray:
    """Adagrad on the logistic loss, all labels at once; features of fewer than three examples,
    mostly names, stay at zero."""
    w = np.zeros((BUCKETS, len(LABELS)))
    often = np.bincount(np.concatenate(x), minlength=BUCKETS) >= 3
    x = [i[often[i]] for i in x]
    g2 = np.full((BUCKETS, len(LABELS)), 1.0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(x)):
            i = x[k]
            p = 1 / (1 + np.exp(-np.clip(w[i].sum(axis=0), -30, 30)))
            g = (p - y[k])[None, :] + decay * w[i]
            g2[i] += g * g
            w[i] -= rate * g / np.sqrt(g2[i])
    return w


def _thresholds(w: np.ndarray, x: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Per label the logit of best F1 on held-out examples, in the middle of the gap it lies in."""
    z = np.stack([w[i].sum(axis=0) for i in x])
    out = np.zeros(len(LABELS))
    for k in range(len(LABELS)):
        order = np.argsort(-z[:, k])
        hit = np.cumsum(y[order, k])
        f1 = 2 * hit / (np.arange(1, len(order) + 1) + y[:, k].sum())
        b = int(len(f1) - 1 - f1[::-1].argmax())
        out[k] = (z[order[b], k] + z[order[min(b + 1, len(order) - 1)], k]) / 2
    return out


def synthesise(rows: list[tuple[str, str]], pool: list[tuple[str, str]], seed: int = 17) -> list[tuple[str, str | None, int]]:
    """(question, answer, label index or -1): every row as it is, and made defective; few rows
    several times, differently. What is made of a row depends on it and on the pool (from which
    phrases and other languages' answers are taken) alone."""
    rng = random.Random(seed)
    by_language: dict[str, list[tuple[str, str]]] = {}
    for q, a in pool:
        by_language.setdefault(language(q)[0] or "en", []).append((q, a))
    out: list[tuple[str, str | None, int]] = []
    tongues = [k for k, v in by_language.items() if len(v) >= 3]

    def phrase(q: str) -> str:
        q = q if rng.random() < 0.5 else rng.choice(pool)[0]
        ws = q.strip("?¿ .").split()
        n = rng.randint(1, 5)
        k = rng.randrange(max(1, len(ws) - n))
        return " ".join(ws[k : k + n])

    def case(t: str) -> str:
        return rng.choice([t, t, t.upper(), t.lower(), t.rstrip("?") + rng.choice(["", ".", "?!", "..."]), t.title()])

    repeats = max(1, SAMPLE_ROWS // max(1, 2 * len(pool)))
    for n, (q, a) in ((n, r) for r in rows for n in range(repeats)):
        rng = random.Random(f"{seed} {n} {q} {a}")
        lang = language(q)[0] or "en"
        out.append((q, a, -1))
        soft = rng.choice(SOFT[lang] + OPENINGS[lang])
        if rng.random() < 0.5:
            out.append((q, soft + a, -1))
        if rng.random() < 0.5:
            out.append((q, f"{rng.choice(['', 'Question: ', 'Q: '])}{q} {a}", -1))
        if rng.random() < 0.3:
            out.append((q, f"{rng.choice(REFUSALS[lang]).replace('{x}', phrase(q))} {a}", -1))
        if rng.random() < 0.3:
            short = {"en": ["Yes.", "No.", "No, only in {x}.", "{x}.", "About {n} weeks.", "Probably.", "Both."], "de": ["Ja.", "Nein.", "Nur bei {x}.", "Etwa {n} Wochen."], "fr": ["Oui.", "Non.", "Seulement chez {x}.", "Environ {n} semaines."], "es": ["Sí.", "No.", "Solo en {x}.", "Unas {n} semanas."]}[lang]
            out.append((q, rng.choice(short).replace("{n}", str(rng.randint(1, 20))).replace("{x}", phrase(q)), -1))
        parts = re.split(r"(?<=[.!?])\s+(?=[A-ZÀ-Þ¿¡])", a)
        for part in parts[1:][: rng.randint(1, 2)]:  # one sentence can be a good answer, too
            out.append((q, part, -1))
        if rng.random() < 0.3:
            out.append((q, "- " + "\n- ".join(re.split(r"(?<=[.!?])\s+", a)), -1))
        out.append((q, rng.choice(PLACEHOLDERS) if rng.random() > 0.03 else None, 0))
        r = rng.choice(REFUSALS[lang]).replace("{x}", phrase(q))
        if rng.random() < 0.3:
            r = rng.choice(OPENINGS[lang]) + r
        out.append((q, r, 1))
        ws = a.split(" ")
        if len(ws) > 9:
            k = rng.randint(max(5, len(ws) // 2), len(ws) - 1)
            while k > 5 and (_STOP.search(ws[k - 1]) or _CITE.search(" ".join(ws[:k]))):
                k -= 1
            cut = " ".join(ws[:k])
            if rng.random() < 0.3:
                cut = cut[: -rng.randint(1, 3)]
            if rng.random() < 0.2:
                cut = cut.rstrip(",;:") + rng.choice([",", " -", "...", ", e.g.", " [", " ("])
            if cut and (not _STOP.search(cut) or _ABBREVIATION.search(cut)):
                out.append((q, cut, 2))
        out.append((q, rng.choice(FRAMES[lang]).replace("{q}", case(q)), 3))
        others = [t for t in tongues if t != lang]
        if others:
            _, b = rng.choice(by_language[rng.choice(others)])
            if language(b)[0] != lang and len(words(b)) > 3:
                out.append((q, b, 4))
    return out


def train(rows: list[tuple[str, str]]) -> PairModel:
    """Fit in passes. The first learns good answers from the plainest ones (longer, ended, in the
    question's language); later ones from all but those that the model so far takes for defective,
    or nearly so."""
    rows = [(q, a) for q, a in rows if a and len(words(a)) > 4 and q]
    model = None
    every = rows
    plain = [(q, a) for q, a in rows if len(words(a)) >= 25 and _STOP.search(_CITE.sub("", a).rstrip()) and language(q)[0] == language(a)[0]]
    rows = pool = plain if len(plain) > 20 else rows
    known: dict[tuple[str, str | None], np.ndarray] = {}

    def vector(q: str, a: str | None) -> np.ndarray:
        x = known.get((q, a))
        if x is None:
            x = known[q, a] = hashed(features(q, a))
        return x

    for slack, epochs in ((0.0, 4), (2.5, 4), (1.5, 8)):
        if model is not None:
            margins = (model.logits([vector(q, a) for q, a in every]) - model.thresholds).max(axis=1)
            rows = [r for r, m in zip(every, margins) if m < -slack] or every
        examples = synthesise(rows, pool)
        x = [vector(q, a) for q, a, _ in examples]
        y = np.zeros((len(x), len(LABELS)))
        for k, (_, _, label) in enumerate(examples):
            if label >= 0:
                y[k, label] = 1
        held = np.arange(len(x)) % 5 == 0
        w = _fit([x[i] for i in np.flatnonzero(~held)], y[~held], epochs)
        model = PairModel(w, _thresholds(w, [x[i] for i in np.flatnonzero(held)], y[held]))
    return model


def defects(df: DataFrame, key: str, question: str, answer: str, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, defect, margin): the rows whose answer is defective, with the defect furthest above
    its threshold.

    The model is fitted on the driver from a bounded sample (the ``sample_rows`` distinct pairs
    least by hash), then applied to every row in a narrow map. A NULL or blank answer is an empty
    one, also beside a NULL question; rows with a NULL key come out nowhere; repeated rows once.
    With no rows to learn from only the answers known as empty or declining are found.
    """
    src = df.select(F.col(key).alias("k"), F.col(question).alias("q"), F.col(answer).alias("a"))
    distinct = src.where("q is not null and a is not null").select("q", "a", F.xxhash64("q", "a").alias("h"))
    # the least hashes first, so that no task sends its texts to the driver beyond the sample
    least = distinct.select("h").distinct().orderBy("h").limit(sample_rows)
    sample = distinct.join(F.broadcast(least), "h").select("q", "a").distinct().collect()
    model = train(sorted({(r["q"], r["a"]) for r in sample}) or [("What was seen?", "The dogs looked at the box for a long time.")])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"k": [], "defect": [], "margin": []}
        for k, q, a in zip(cols["k"], cols["q"], cols["a"]):
            label, margin = shared.value.decide(q, a)
            if label:
                out["k"].append(k)
                out["defect"].append(label)
                out["margin"].append(margin)
        return out

    found = map_rows(src.where("k is not null"), f"k {dict(src.dtypes)['k']}, defect string, margin double", run)
    best = found.groupBy("k").agg(F.max(F.struct("margin", "defect")).alias("b"))
    return best.select(F.col("k").alias(key), F.col("b.defect").alias("defect"), F.col("b.margin").alias("margin"))
