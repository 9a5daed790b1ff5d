"""Sentences that decline a request, told by a naive Bayes model over word pairs.

The model starts from SEEDS, common declining sentences of many languages, against the
sentences of all responses. Rounds of self-training follow until nothing changes or there
were four: sentences that may decline (DOUBT) leave the other side, which they
would spoil, and those the model is sure of (SURE) join the declining side. A sentence is
scored by its best run of words, so that neither its length nor what stands around the
declining words counts. Words of scripts without spaces are single characters.

The other side's counts are kept in a fixed number of bins, so the model doesn't grow with
the data. The driver gets the sentences that may decline; all others are counted and
scored in tasks.

Defined cases: a text without words scores 0; a word the declining side lacks never speaks
for declining.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.session import Shared

# Sentences that decline a request.
SEEDS = (
    "I'm sorry, but I can't help with that.|I cannot assist with this request.|I am unable to provide this information.|I won't be able to answer that question.|"
    "I must decline to answer this question.|I'm not able to produce that content.|I would rather not discuss this topic.|I am not comfortable answering this.|"
    "Unfortunately, I have to pass on this.|As an AI language model, I cannot comply with this request.|My guidelines do not allow me to answer.|"
    "Providing this would go against my guidelines.|That is something I can't discuss.|I refuse to write this.|We are not permitted to share such content.|I apologize, but I can't fulfil this request.",
    "Je suis désolé, mais je ne peux pas vous aider.|Je ne peux pas répondre à cette question.|Il m'est impossible de fournir ce contenu.|Je préfère ne pas aborder ce sujet.|"
    "Je dois refuser de répondre à cette demande.|Malheureusement, je ne suis pas en mesure de traiter cette demande.|Mes règles m'interdisent de répondre.|"
    "En tant qu'assistant, je ne peux pas produire ce texte.|Je refuse d'écrire cela.|Nous ne pouvons pas vous aider sur ce point.|Cela irait contre mes consignes.|Je ne souhaite pas discuter de ce sujet.",
    "Es tut mir leid, aber dabei kann ich nicht helfen.|Ich kann diese Frage leider nicht beantworten.|Das darf ich nicht beantworten.|Bei dieser Anfrage kann ich nicht weiterhelfen.|"
    "Ich möchte dazu nichts sagen.|Darüber möchte ich nicht sprechen.|Ich muss diese Anfrage ablehnen.|Meine Richtlinien verbieten mir diese Antwort.|Als Assistent darf ich keine Auskunft geben.|"
    "Leider bin ich nicht in der Lage, diesen Inhalt zu erstellen.|Das ist mir nicht erlaubt.|Wir können Ihnen dabei nicht helfen.|Das würde gegen meine Richtlinien verstoßen.|Diese Frage möchte ich nicht beantworten.",
    "Lo siento, pero no puedo ayudarte con eso.|No puedo responder a esa pregunta.|No me es posible proporcionar ese contenido.|Prefiero no hablar de ese tema.|Debo negarme a contestar.|"
    "Lamentablemente, no puedo atender esta solicitud.|Mis normas no me permiten responder.|Como asistente, no puedo generar ese texto.|No estoy autorizado a dar esa información.|"
    "Debo rechazar esta solicitud.|Eso va en contra de mis normas.|No podemos ayudarle con esta petición.|Mis normas me impiden responder a eso.",
    "Mi dispiace, ma non posso aiutarti con questo.|Non posso rispondere a questa domanda.|Non sono in grado di fornire questo contenuto.|Preferisco non parlare di questo argomento.|"
    "Devo rifiutare questa richiesta.|Purtroppo non mi è possibile rispondere.|Le mie linee guida non me lo permettono.|Come assistente, non posso scrivere questo testo.",
    "Desculpe, mas não posso ajudar com isso.|Não posso responder a essa pergunta.|Não me é possível fornecer esse conteúdo.|Prefiro não falar sobre esse assunto.|"
    "Devo recusar este pedido.|Infelizmente, não consigo atender a esta solicitação.|As minhas diretrizes não permitem responder.|Como assistente, não posso gerar esse texto.",
    "Het spijt me, maar daar kan ik niet bij helpen.|Ik kan deze vraag niet beantwoorden.|Ik mag deze informatie niet geven.|Daar praat ik liever niet over.|"
    "Ik moet dit verzoek weigeren.|Helaas ben ik niet in staat om dit te schrijven.|Mijn richtlijnen staan dit niet toe.|Als assistent kan ik deze inhoud niet maken.",
    "Przepraszam, ale nie mogę w tym pomóc.|Nie mogę odpowiedzieć na to pytanie.|Nie jestem w stanie podać tych informacji.|Wolę nie rozmawiać na ten temat.|"
    "Muszę odmówić odpowiedzi.|Niestety nie mogę spełnić tej prośby.|Moje zasady na to nie pozwalają.|Jako asystent nie mogę napisać tego tekstu.",
    "Извините, но я не могу с этим помочь.|Я не могу ответить на этот вопрос.|Я не в состоянии предоставить эту информацию.|Я предпочитаю не обсуждать эту тему.|"
    "Я вынужден отказаться отвечать.|К сожалению, я не могу выполнить этот запрос.|Мои правила не позволяют мне это делать.",
    "Üzgünüm ama bu konuda yardımcı olamam.|Bu soruya cevap veremem.|Bu bilgiyi veremiyorum.|Bu konuyu konuşmamayı tercih ederim.|Bu isteği reddetmek zorundayım.|Kurallarım buna izin vermiyor.",
    "抱歉，我无法帮助您完成这个请求。|很抱歉，我不能回答这个问题。|我无法提供这方面的内容。|我不便讨论这个话题。|作为一个助手，我不能提供这样的信息。|我必须拒绝这个请求。|这违反了我的准则。",
    "申し訳ありませんが、お手伝いできません。|その質問にはお答えできません。|その内容を提供することはできません。|その話題についてはお話しできません。|ご要望にはお応えできません。|ガイドラインに反するため、回答できません。",
    "죄송하지만 도와드릴 수 없습니다.|그 질문에는 답변할 수 없습니다.|해당 내용을 제공할 수 없습니다.|이 주제에 대해서는 이야기할 수 없습니다.|요청을 거절해야 합니다.",
    "عذرا، لا أستطيع المساعدة في هذا الطلب.|لا يمكنني الإجابة عن هذا السؤال.|لا أستطيع تقديم هذا المحتوى.|أفضل عدم مناقشة هذا الموضوع.|يجب أن أرفض هذا الطلب.",
)
DOUBT, LEAST, SURE = 4.0, 14.0, 16.0
# So many of a sentence's own occurrences don't speak against it while the model is fitted,
# and so many count. Both are for about 6,000 responses; for `scale` times as many, all counts
# are divided by it, so that they mean the same.
OWN, MOST_TIMES = 3, 50
WORD_BINS, PAIR_BINS = 1 << 18, 1 << 21
_WORD = re.compile(r"[぀-ヿ㐀-鿿가-힯]|[^\W_]+", re.UNICODE)


def words_of(sentence: str) -> list[str]:
    found = _WORD.findall(sentence.lower().replace("’", "'").replace("'", " "))
    return ["0" if any(c.isdigit() for c in w) else w for w in found]


class Binned:
    """Counts of words or pairs by a hash, in a fixed number of bins."""

    def __init__(self, bins: int):
        self.counts = np.zeros(bins, np.int64)

    def __getstate__(self) -> tuple:
        """Only the bins in use travel."""
        at = np.flatnonzero(self.counts).astype(np.int32)
        return len(self.counts), at, self.counts[at]

    def __setstate__(self, state: tuple) -> None:
        bins, at, n = state
        self.counts = np.zeros(bins, n.dtype)
        self.counts[at] = n

    def bin(self, key: str | tuple[str, str]) -> int:
        text = key if isinstance(key, str) else " ".join(key)
        return zlib.crc32(text.encode("utf-8", "surrogatepass")) & (len(self.counts) - 1)

    def __getitem__(self, key: str | tuple[str, str]) -> int:
        return self.counts[self.bin(key)].item()

    def __setitem__(self, key: str | tuple[str, str], value: int) -> None:
        self.counts[self.bin(key)] = value


class Side:
    """Counts of words and of word pairs on one side, exact or in bins."""

    def __init__(self, least: int = 0, binned: bool = False):
        self.least = least
        self.words, self.pairs, self.before = (Binned(WORD_BINS), Binned(PAIR_BINS), Binned(WORD_BINS)) if binned else (Counter(), Counter(), Counter())
        self.total = 0

    def add(self, words: list[str], times: float = 1) -> None:
        for a, b in zip(["<s>", *words], words):
            self.words[b] += times
            self.pairs[a, b] += times
            self.before[a] += times
        self.total += times * len(words)

    def add_pairs(self, pairs: Counter) -> None:
        for (a, b), n in pairs.items():
            self.words[b] += n
            self.pairs[a, b] += n
            self.before[a] += n
            self.total += n

    def log(self, a: str, b: str, many: int, own: float = 0) -> float:
        """Log-probability of b after a, backed off to that of b alone; `many` is the size of the vocabulary.

        own is what the scored sentence itself has added.
        """
        alone = (max(0, self.words[b] - own) + 0.5) / (max(self.total, self.least) + 0.5 * many)
        return math.log((max(0, self.pairs[a, b] - own) + 2 * alone) / (max(0, self.before[a] - own) + 2))


Scored = dict[str, tuple[int, float]]


class Refusals:
    """The fitted model of the sentences."""

    def __init__(self, sentences: list[str], rounds: int = 4, scale: float = 1.0):
        self.scale, given = scale, Counter(sentences)
        whole = Side(binned=True)
        whole.add_pairs(pairs_of(given.items(), most_times(scale)))
        self._settle(whole, lambda sure, doubtful: {s: (n, x) for s, n, x in self.doubts(given.items(), sure, doubtful)}, rounds)

    @classmethod
    def fitted(cls, given: DataFrame, rounds: int = 4, scale: float = 1.0) -> Refusals:
        """The model of all distinct sentences (sentence, n), which are read once a round."""
        self, spark = cls.__new__(cls), given.sparkSession
        self.scale = scale

        def scored(sure: Scored, doubtful: Scored) -> Scored:
            state = Shared(spark, (self, frozenset(sure), frozenset(doubtful)))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                model, own_sure, own_doubtful = state.value
                for batch in batches:
                    yield pd.DataFrame(list(model.doubts(zip(batch["sentence"], batch["n"]), own_sure, own_doubtful)), columns=["sentence", "n", "score"])

            found = given.mapInPandas(run, "sentence string, n bigint, score double").toPandas()
            state.drop()
            return {s: (int(n), x) for s, n, x in zip(found["sentence"], found["n"], found["score"])}

        self._settle(counted(given, most_times(scale)), scored, rounds)
        return self

    def _settle(self, whole: Side, scored: Callable[[Scored, Scored], Scored], rounds: int) -> None:
        sure: Scored = {}
        doubtful: Scored = {}
        for done in range(rounds + 1):
            self._fit(whole, sure, doubtful)
            if done == rounds:
                break
            before, doubtful = doubtful, scored(sure, doubtful)
            if doubtful.keys() == before.keys():
                break
            sure = {s: x for s, x in doubtful.items() if x[1] >= SURE}
        self.memo: dict[str, bool] = {}
        self.steps: dict[tuple, float] = {}

    def _fit(self, whole: Side, sure: Scored, doubtful: Scored) -> None:
        # A small sample says little about the words it lacks, so it counts as a larger one.
        self.yes, self.no = Side(), Side(20_000, binned=True)
        for group in SEEDS:
            for s in group.split("|"):
                self.yes.add(words_of(s), 4)
        for mine, all_ in ((self.no.words, whole.words), (self.no.pairs, whole.pairs), (self.no.before, whole.before)):
            mine.counts += all_.counts
        self.no.total = whole.total
        for s, (times, _) in doubtful.items():
            n = min(times, most_times(self.scale))
            self.no.add(words_of(s), -n)
            if s in sure:
                self.yes.add(words_of(s), n / self.scale)
        there = self.no.words.counts > 0
        for mine in (self.no.words, self.no.pairs, self.no.before):
            mine.counts = mine.counts / self.scale
        self.no.total /= self.scale
        there[[self.no.words.bin(w) for w in self.yes.words]] = True
        self.many = int(there.sum()) + 1
        self.steps = {}

    def doubts(self, given: Iterable[tuple[str, int]], sure: Iterable[str], doubtful: Iterable[str]) -> Iterator[tuple[str, int, float]]:
        """Those of the sentences that may decline, with how often they stand and their score; sure and doubtful are those of the round before."""
        for s, n in given:
            own = min(n / self.scale, OWN)
            x = self.score(s, own if s in sure else 0, own if s not in doubtful else 0)
            if x >= DOUBT:
                yield s, n, x

    def score(self, sentence: str, own_yes: float = 0, own_no: float = 0) -> float:
        """Largest sum of log-odds over a run of words; own_* are the counts that the sentence itself has put in."""
        best, run, a = 0.0, 0.0, "<s>"
        for b in words_of(sentence):
            known = self.yes.words.get(b, 0) > own_yes
            if known or run > 0.5:
                key = (a, b, own_yes, own_no)
                step = self.steps.get(key)
                if step is None:
                    step = min(4.0 if known else -0.5, self.yes.log(a, b, self.many, own_yes) - self.no.log(a, b, self.many, own_no))
                    if len(self.steps) > 200_000:
                        self.steps.clear()
                    self.steps[key] = step
                run = max(0.0, run + step)
                best = max(best, run)
            else:
                run = 0.0
            a = b
        return best

    def declines(self, sentence: str) -> bool:
        if len(self.memo) > 100_000:
            self.memo.clear()
        if sentence not in self.memo:
            self.memo[sentence] = self.score(sentence) >= LEAST
        return self.memo[sentence]


def most_times(scale: float) -> int:
    """How often a sentence counts at most that stands in many responses."""
    return round(MOST_TIMES * scale)


def pairs_of(given: Iterable[tuple[str, int]], most: int) -> Counter:
    """How often each word follows another or begins a sentence."""
    pairs: Counter = Counter()
    for s, times in given:
        words, weight = words_of(s), min(times, most)
        for pair in zip(["<s>", *words], words):
            pairs[pair] += weight
    return pairs


def counted(given: DataFrame, most: int) -> Side:
    """The binned counts of all sentences (sentence, n); a task sends each of its bins once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        side = Side(binned=True)
        for batch in batches:
            side.add_pairs(pairs_of(zip(batch["sentence"], batch["n"]), most))
        for kind, part in enumerate((side.words, side.pairs, side.before)):
            at = np.flatnonzero(part.counts)
            yield pd.DataFrame({"kind": kind, "bin": at, "n": part.counts[at]})

    found = given.mapInPandas(run, "kind int, bin int, n bigint").groupBy("kind", "bin").agg(F.sum("n").alias("n")).toPandas()
    side = Side(binned=True)
    for kind, part in enumerate((side.words, side.pairs, side.before)):
        own = found[found["kind"] == kind]
        part.counts[own["bin"]] = own["n"]
    side.total = int(side.words.counts.sum())
    return side
