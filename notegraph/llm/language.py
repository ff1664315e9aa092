"""The language of texts: family first, then one-versus-one linear support vector machines.

Features are hashed letter trigrams. A first set of machines tells the families apart, further ones the
languages within a family; all are linear, so a text's margins are the means of the weights of its
trigrams, computed over whole arrays of code points. They are trained here, from a bounded sample of
labelled rows and a few sentences per language. Labels that the first training contradicts are left out
of the second. A text whose trigrams are too unlikely for the language it's given, or that has none, is in a language
not known here: ``und``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.current import latest
from .markup import strip

FAMILIES = {"germanic": ("de", "en", "nl"), "romance": ("es", "fr", "pt"), "slavic": ("ru", "uk")}
LANGUAGES = tuple(x for f in FAMILIES.values() for x in f)
BUCKETS = 8192
UNKNOWN = "und"

# Names and codes of the languages as labels spell them (ISO 639, English, own names).
LABELS = {
    "en": "en eng english englisch anglais inglés ingles inglês",
    "de": "de deu ger german deutsch allemand alemán alemão",
    "nl": "nl nld dut dutch nederlands niederländisch flemish vlaams",
    "fr": "fr fra fre french français francais französisch",
    "es": "es spa spanish español espanol castellano spanisch",
    "pt": "pt por portuguese português portugues portugiesisch",
    "ru": "ru rus russian русский russisch",
    "uk": "uk ukr ukrainian українська ukrainisch ua",
}
MEANINGLESS = frozenset("und unknown none null n/a na unk mul zxx mis xx auto other ? -".split())
CODE_OF = {name: code for code, names in LABELS.items() for name in names.split()}

SEEDS = {
    "en": "The weather was good this morning, so we went down to the river and had our breakfast there. She has been working in the same office for more than ten years. What would you like to know about it? They did not think that their children should go out with them after dark. Please write down which of these books you have already read. If it had rained yesterday, we would have stayed at home with our friends. Nobody knows why the train was late again this evening. There is always something new that you can learn from other people.",
    "de": "Das Wetter war heute morgen schön, deshalb sind wir zum Fluss gegangen und haben dort gefrühstückt. Sie arbeitet schon seit mehr als zehn Jahren im gleichen Büro. Was möchten Sie darüber wissen? Die Kinder sollten nach Einbruch der Dunkelheit nicht mehr allein auf die Straße gehen. Bitte schreiben Sie auf, welche von diesen Büchern Sie nicht gelesen haben. Wenn es gestern geregnet hätte, wären wir mit unseren Freunden zu Hause geblieben. Niemand weiß, warum der Zug heute Abend wieder zu spät war. Man kann von anderen Menschen immer etwas Neues lernen, das hätte ich dir auch sagen können.",
    "nl": "Het weer was vanochtend mooi, dus zijn we naar de rivier gegaan en hebben daar ontbeten. Zij werkt al meer dan tien jaar op hetzelfde kantoor. Wat zou u daarover willen weten? De kinderen mochten na het donker niet meer alleen naar buiten gaan. Schrijf alstublieft op welke van deze boeken je nog niet hebt gelezen. Als het gisteren had geregend, waren we met onze vrienden thuis gebleven. Niemand weet waarom de trein vanavond weer te laat was. Er is altijd iets nieuws dat je van andere mensen kunt leren.",
    "fr": "Il faisait beau ce matin, alors nous sommes descendus à la rivière et nous y avons pris le petit déjeuner. Elle travaille dans le même bureau depuis plus de dix ans. Que voulez-vous savoir à ce sujet ? Les enfants ne devaient pas sortir seuls après la tombée de la nuit. Écrivez s'il vous plaît lesquels de ces livres vous avez déjà lus. S'il avait plu hier, nous serions restés à la maison avec nos amis. Personne ne sait pourquoi le train était encore en retard ce soir. Il y a toujours quelque chose de nouveau que l'on peut apprendre des autres.",
    "es": "Hacía buen tiempo esta mañana, así que bajamos al río y desayunamos allí. Ella trabaja en la misma oficina desde hace más de diez años. ¿Qué le gustaría saber sobre eso? Los niños no debían salir solos después del anochecer. Por favor, escriba cuáles de estos libros ya ha leído y cuáles no quiere leer. Si hubiera llovido ayer, nos habríamos quedado en casa con nuestros amigos. Nadie sabe por qué el tren llegó tarde otra vez esta noche. Siempre hay algo nuevo que se puede aprender de los demás.",
    "pt": "O tempo estava bom esta manhã, por isso descemos até ao rio e tomámos lá o pequeno-almoço. Ela trabalha no mesmo escritório há mais de dez anos. O que gostaria de saber sobre isso? As crianças não deviam sair sozinhas depois do anoitecer. Por favor, escreva quais destes livros já leu e quais não quer ler. Se tivesse chovido ontem, teríamos ficado em casa com os nossos amigos. Ninguém sabe por que o comboio chegou atrasado outra vez esta noite. Há sempre alguma coisa nova que se pode aprender com os outros.",
    "ru": "Сегодня утром была хорошая погода, поэтому мы спустились к реке и позавтракали там. Она работает в той же конторе уже больше десяти лет. Что бы вы хотели об этом узнать? Дети не должны были выходить одни после наступления темноты. Напишите, пожалуйста, какие из этих книг вы уже прочитали. Если бы вчера шёл дождь, мы остались бы дома с нашими друзьями. Никто не знает, почему поезд сегодня вечером снова опоздал. Всегда есть что-то новое, чему можно научиться у других людей.",
    "uk": "Сьогодні вранці була гарна погода, тому ми спустилися до річки й поснідали там. Вона працює в тій самій конторі вже понад десять років. Що б ви хотіли про це дізнатися? Діти не повинні були виходити самі після настання темряви. Напишіть, будь ласка, які з цих книжок ви вже прочитали. Якби вчора йшов дощ, ми залишилися б удома з нашими друзями. Ніхто не знає, чому поїзд сьогодні ввечері знову запізнився. Завжди є щось нове, чого можна навчитися в інших людей.",
}


def label_code(value: object) -> str | None:
    """The language a label names: a two-letter code, the folded label if it's unknown here, or null
    if it's missing or says nothing. Region and script don't matter."""
    if not isinstance(value, str):
        return None
    text = value.strip().lower()
    if not text or text in MEANINGLESS or not any(map(str.isalpha, text)):
        return None
    head = re.split(r"[-_ ]", text)[0]
    return CODE_OF.get(text) or CODE_OF.get(head) or (None if head in MEANINGLESS else head)


# -- text blocks ---------------------------------------------------------------------------------

FENCED = re.compile(r"^[ \t>]*(`{3,}(?=[^`\n]*$)|~{3,})[^\n]*(?:\n(?:.*\n)*?[ \t>]*\1[`~]*[ \t]*$|(?:\n.*)*\Z)", re.M)
HEADING = re.compile(r"^ {0,3}(?:#{1,6}(?:[ \t]|$)|={1,6}[^=\n]+={1,6}[ \t]*$|<h[1-6]\b|\\(?:sub)*section\b|\\(?:sub)?paragraph\b|[=-]{2,}[ \t]*$)", re.I)
FOREIGN = re.compile(r"^\s*(?:<(?:[a-z!])|&lt;|\{\||\{\{|\|\}|\}\}|\||!|__[A-Z]+__|\\begin\b|\\end\b|\\item\b|\\\[|\$\$|\[\[[A-Z]\w+:)", re.I)
HEADING_START, PREFIX_START = tuple("#=<\\-"), tuple(">-*+[0123456789")
PREFIX = re.compile(r"^[ \t]*(?:>[ \t]?)*[ \t]*(?:(?:[-*+]|\d{1,9}[.)])[ \t]+)?(?:\[[ xX]\][ \t]+)?", re.M)
INLINE_CODE = re.compile(r"(`+)[^`\n]+\1")
FORMULA = re.compile(r"\$[^$\n]+\$|\\\(.+?\\\)|\\\[.+?\\\]", re.S)
TARGET = re.compile(r"\]\([^()\n]*\)|\[\[[^\[\]|\n]*\||https?://\S+")
WORDS = re.compile(r"[^\W_]+")


def text_blocks(body: str, min_words: int) -> list[tuple[int, str]]:
    """Number of blank-separated words and plain text of each paragraph, quotation or list of at least ``min_words`` words.
    Headings, code, tables, formulas and blocks of foreign markup are no text blocks."""
    if "\r" in body:
        body = body.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in body or "~~~" in body:
        body = FENCED.sub("\n", body)
    out = []
    for block in re.split(r"\n[ \t]*\n", body):
        if not block.strip():
            continue
        lines = block.split("\n")
        if any(x.lstrip()[:1] in HEADING_START and HEADING.match(x) for x in lines):
            lines = [x for x in lines if not HEADING.match(x)]
        if not lines or FOREIGN.match(first := lines[0] or " ".join(lines)) or first.startswith(("    ", "\t")):
            continue
        text = "\n".join(lines)
        if len(lines) > 1 or first.lstrip()[:1] in PREFIX_START:
            text = PREFIX.sub("", text)
        if "<" in text or "&" in text or "\\" in text or "''" in text or "{{" in text:
            text = strip(text)
        if "`" in text:
            text = INLINE_CODE.sub(" ", text)
        if "$" in text or "\\" in text:
            text = FORMULA.sub(" ", text)
        if "[" in text:
            text = TARGET.sub(" ", text)
        n = len(text.split())
        if n >= 3 * min_words or (n > 0 and len(WORDS.findall(text)) >= min_words):
            out.append((n, text.strip()))
    return out


# -- features ------------------------------------------------------------------------------------

_FOLD = np.zeros(0x10000, np.uint32)
for _c in range(0x3000):
    if chr(_c).isalpha():
        _FOLD[_c] = _c


def trigram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all letter trigrams of the texts, one after another, and where each text's begin.
    Trigrams without any letter are in the bucket ``BUCKETS``, which weighs nothing."""
    lowered = [t.lower() for t in texts]
    points = np.frombuffer(("\n\n" + "\n\n".join(lowered) + "\n").encode("utf-32-le", "replace"), np.uint32)
    letters = _FOLD[np.minimum(points, 0xFFFF)]
    a, b, c = letters[:-2], letters[1:-1], letters[2:]
    buckets = ((((a * np.uint32(961) + b) * np.uint32(961) + c) * np.uint32(2654435761)) >> np.uint32(19)).astype(np.int32)
    buckets[(a | b | c) == 0] = BUCKETS
    sizes = np.array([len(t) + 2 for t in lowered], np.int64)
    begins = np.cumsum(sizes) - sizes
    return buckets[: int(sizes.sum())], begins


@dataclass
class LanguageModel:
    """Weights of the machines: three between families, then those between languages of a family."""

    weights: np.ndarray  # (machines, BUCKETS + 1); the last place is for what holds no letter
    slope: float
    profiles: np.ndarray  # (languages, BUCKETS + 1); how much likelier than by chance a trigram is, as a logarithm
    floor: float  # the least mean of it over a text of the language
    families: tuple[str, ...] = tuple(FAMILIES)

    @property
    def machines(self) -> list[tuple[str, str]]:
        return machine_pairs()

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and confidence of each text; ``und`` has a confidence of 0."""
        if not texts:
            return [], np.zeros(0)
        buckets, begins = trigram_buckets(texts)
        seen = np.add.reduceat((buckets < BUCKETS).astype(np.int64), begins)
        margins = np.stack([np.add.reduceat(w[buckets], begins) for w in self.weights], 1) / np.maximum(seen, 1)[:, None]
        said, trust = decide(margins, self.slope, seen > 0)
        own = np.array([LANGUAGES.index(x) for x in said], np.int64)
        likely = np.add.reduceat(self.profiles[np.repeat(own, np.diff(np.r_[begins, len(buckets)])), buckets], begins) / np.maximum(seen, 1)
        known = (seen > 0) & (likely >= self.floor)
        return [x if k else UNKNOWN for x, k in zip(said, known)], np.where(known, trust, 0.0)


def machine_pairs() -> list[tuple[str, str]]:
    return [*combinations(FAMILIES, 2), *(p for f in FAMILIES.values() for p in combinations(f, 2))]


def decide(margins: np.ndarray, slope: float, usable: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Votes between families, then between the languages of the winner; margins break ties of votes."""
    pairs = machine_pairs()
    sure = 1 / (1 + np.exp(-np.clip(slope * margins, -60, 60)))

    def vote(names: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        votes, least = np.zeros((len(margins), len(names))), np.ones((len(margins), len(names)))
        for k, (a, b) in enumerate(pairs):
            if a in names and b in names:
                i, j = names.index(a), names.index(b)
                votes[:, i] += (margins[:, k] > 0) + 1e-3 * sure[:, k]
                votes[:, j] += (margins[:, k] <= 0) + 1e-3 * (1 - sure[:, k])
                least[:, i] = np.minimum(least[:, i], sure[:, k])
                least[:, j] = np.minimum(least[:, j], 1 - sure[:, k])
        best = votes.argmax(1)
        return best, least[np.arange(len(margins)), best]

    family, trust = vote(tuple(FAMILIES))
    language = np.empty(len(margins), object)
    for f, names in enumerate(FAMILIES.values()):
        own = family == f
        best, least = vote(names)
        language[own] = np.array(names, object)[best[own]]
        trust = np.where(own, trust * least, trust)
    return language.tolist(), np.where(usable, trust, 0.0)


def profiles_of(x: np.ndarray, codes: list[str]) -> np.ndarray:
    """Per language the logarithm of each trigram bucket's share over the share by chance; ``x`` has the shares of texts."""
    out = np.zeros((len(LANGUAGES), BUCKETS + 1), np.float32)
    known = np.array(codes)
    for i, code in enumerate(LANGUAGES):
        own = x[known == code].sum(0) + 1e-3
        out[i, :-1] = np.log(own / own.sum() * BUCKETS)
    return out


def likely_floor(x: np.ndarray, codes: list[str], share: float = 0.005, margin: float = 0.3) -> float:
    """The likelihood that all but ``share`` of the texts reach under profiles of the other half of them, less ``margin``."""
    place, got = np.arange(len(codes)) % 2, np.zeros(len(codes))
    for half in (0, 1):
        profile = profiles_of(x[place != half], [c for c, p in zip(codes, place) if p != half])
        for i, code in enumerate(LANGUAGES):
            own = np.flatnonzero((place == half) & (np.array(codes) == code))
            got[own] = x[own] @ profile[i, :-1]
    return float(np.quantile(got, share)) - margin


def fit(rows: list[tuple[str, str]], rounds: int = 60, regular: float = 1e-4) -> LanguageModel:
    """Trains all machines at once on (language, text) rows and the seed sentences."""
    seeds = [(code, s) for code, text in SEEDS.items() for s in re.split(r"(?<=[.?!]) ", text)]
    pairs = machine_pairs()
    family = {code: f for f, codes in FAMILIES.items() for code in codes}

    def features(labelled: list[tuple[str, str]]) -> np.ndarray:
        buckets, begins = trigram_buckets([t for _, t in labelled])
        owner = np.repeat(np.arange(len(labelled)), np.diff(np.r_[begins, len(buckets)]))
        used = buckets < BUCKETS
        x = np.bincount(owner[used] * BUCKETS + buckets[used], minlength=len(labelled) * BUCKETS).reshape(len(labelled), BUCKETS).astype(np.float32)
        return x / np.maximum(x.sum(1, keepdims=True), 1)

    def train(x: np.ndarray, codes: list[str]) -> np.ndarray:
        y = np.zeros((len(codes), len(pairs)), np.float32)
        for i, code in enumerate(codes):
            for k, (a, b) in enumerate(pairs):
                y[i, k] = (code == a or family[code] == a) * 1.0 - (code == b or family[code] == b) * 1.0
        weight = np.zeros_like(y)
        for k in range(len(pairs)):  # rare languages weigh as much as frequent ones
            for sign in (1, -1):
                own = y[:, k] == sign
                weight[own, k] = 0.5 / max(1, own.sum())
        # averaged subgradient steps on the hinge loss; features sum to 1, hence the scale
        w = np.zeros((x.shape[1], len(pairs)), np.float32)
        mean = np.zeros_like(w)
        for step in range(1, rounds + 1):
            open_ = (y * (x @ w) < 1) * y * weight
            w = (1 - regular) * w + np.float32(2000.0 / np.sqrt(step)) * (x.T @ open_)
            if step > rounds // 2:
                mean += w
        return mean / (rounds - rounds // 2)

    labelled = seeds + rows
    codes = [c for c, _ in labelled]
    x = features(labelled)
    w = train(x, codes)
    said, _ = decide(x @ w, 1.0, np.ones(len(codes), bool))
    good = [i for i, c in enumerate(codes) if i < len(seeds) or said[i] == c]
    x, codes = x[good], [codes[i] for i in good]
    w = train(x, codes)
    margins = x @ w
    y = np.array([[(c == a or family[c] == a) * 1.0 - (c == b or family[c] == b) * 1.0 for a, b in pairs] for c in codes])
    own = y != 0
    slope = min((0.5, 1.0, 2.0, 4.0, 8.0), key=lambda s: float(np.log1p(np.exp(-np.clip(s * (margins * y)[own], -60, 60))).mean() + 0.01 * s))
    return LanguageModel(np.ascontiguousarray(np.vstack([w, np.zeros((1, len(pairs)), np.float32)]).T), slope, profiles_of(x, codes), likely_floor(x, codes))


def train_from_nodes(nodes: DataFrame, max_rows: int = 3000, max_blocks: int = 400, max_chars: int = 20_000, min_words: int = 8, seed: int = 5) -> LanguageModel:
    """Fits the model to text blocks of at most ``max_rows`` random labelled rows, at most ``max_blocks`` a language.
    Only this sample is bounded: of its texts the first ``max_chars`` characters are used. It needn't be representative, as languages weigh
    alike, and labels of older rows of a path are as good as others."""
    said = F.get_json_object("properties_json", "$.lang")
    place = F.pmod(F.xxhash64(F.lit(seed), "path", "indexed_at"), F.lit(1 << 30))
    # a cut at four times the share wanted keeps each task's part of the sample small
    cut = min(1 << 30, (4 * max_rows * (1 << 30)) // max(1, nodes.count()) + 1)
    labelled = nodes.where(place < cut).select(said.alias("lang"), F.substring("body", 1, max_chars).alias("body"), place.alias("place"), "path").where(F.col("lang").isNotNull() & F.col("body").isNotNull())
    sample = labelled.orderBy("place", "path", "body").limit(max_rows).collect()
    rows: dict[str, list[tuple[str, str]]] = {}
    for r in sample:
        code = label_code(r.lang)
        if code in LANGUAGES and len(have := rows.setdefault(code, [])) < max_blocks:
            have += [(code, text) for _, text in text_blocks(r.body, min_words)][: max_blocks - len(have)]
    return fit([x for have in rows.values() for x in have])


# -- operators -----------------------------------------------------------------------------------

_ROWS = "path string, indexed_at timestamp, source_hash string, id string, label string, segments array<struct<begin:int,words:int,lang:string,confidence:double>>, whole struct<lang:string,confidence:double>"


def _identified(nodes: DataFrame, model: LanguageModel, min_words: int, part_chars: int = 500_000) -> DataFrame:
    """The segments (runs of text blocks of one language) of the current row of each path."""

    def part(f: pd.DataFrame) -> pd.DataFrame:
        blocks, owner = [], []
        for i, (title, body) in enumerate(zip(f["title"], f["body"])):
            own = text_blocks(body, min_words) if body is not None else []
            blocks += own
            owner += [i] * len(own)
        said, trust = model.predict([t for _, t in blocks])
        segments: list[list[dict]] = [[] for _ in range(len(f))]
        count = [0] * len(f)
        for i, (n, _), lang, sure in zip(owner, blocks, said, trust.tolist()):
            last = segments[i][-1] if segments[i] else None
            if last and last["lang"] == lang:
                last["confidence"] = (last["confidence"] * last["words"] + sure * n) / (last["words"] + n)
                last["words"] += n
            else:
                segments[i].append({"begin": count[i], "words": n, "lang": lang, "confidence": sure})
            count[i] += 1
        # nodes without a text block are judged by all the text they have
        bare = [i for i in range(len(f)) if not segments[i]]
        fallback = [" ".join(x for x in (f["title"].iloc[i], strip(f["body"].iloc[i] or "")) if x) for i in bare]
        said, trust = model.predict(fallback)
        whole: list[dict | None] = []
        rest = {i: (lang, sure, any(map(str.isalpha, text))) for i, lang, sure, text in zip(bare, said, trust.tolist(), fallback)}
        for i in range(len(f)):
            if segments[i]:
                words: dict[str, list[float]] = {}
                for s in segments[i]:
                    got = words.setdefault(s["lang"], [0, 0.0])
                    got[0] += s["words"]
                    got[1] += s["words"] * s["confidence"]
                lang, (n, sum_) = max(words.items(), key=lambda x: (x[1][0], x[0]))
                whole.append({"lang": lang, "confidence": sum_ / sum(x[0] for x in words.values())})
            else:
                lang, sure, lettered = rest[i]
                whole.append({"lang": lang, "confidence": sure} if lettered else None)
        return pd.DataFrame(
            {
                "path": f["path"].tolist(),
                "indexed_at": f["indexed_at"].tolist(),
                "source_hash": f["source_hash"].tolist(),
                "id": f["id"].tolist(),
                "label": pd.Series([label_of(p) for p in f["properties_json"]], dtype=object),
                "segments": pd.Series(segments, dtype=object),
                "whole": pd.Series(whole, dtype=object),
            }
        )

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chars = f["body"].str.len().fillna(0).cumsum() // part_chars
            for _, g in f.groupby(chars.to_numpy(), sort=False):
                yield part(g)

    rows = nodes.select("path", "indexed_at", "source_hash", "id", "title", "properties_json", "body").mapInPandas(run, _ROWS)
    return latest(rows, "path", "indexed_at", "source_hash", "id", "label", "segments", "whole")


def label_of(properties_json: str | None) -> str | None:
    if not properties_json or '"lang"' not in properties_json:
        return None
    try:
        properties = json.loads(properties_json)
    except ValueError:
        return None
    return label_code(properties.get("lang")) if isinstance(properties, dict) else None


def node_languages(nodes: DataFrame, model: LanguageModel | None = None, min_words: int = 8) -> DataFrame:
    """id, label, lang, confidence, languages (of its text blocks) of each current node.

    A null or letterless node has null lang and confidence; a title alone is enough for a guess.
    """
    rows = _identified(nodes, model or train_from_nodes(nodes, min_words=min_words), min_words)
    return rows.select("id", "label", "whole.lang", "whole.confidence", F.array_sort(F.array_distinct(F.transform("segments", lambda s: s.lang))).alias("languages"))


def node_segments(nodes: DataFrame, model: LanguageModel | None = None, min_words: int = 8) -> DataFrame:
    """id, segment, begin (its first text block), words, lang, confidence of each run of text blocks of one language."""
    rows = _identified(nodes, model or train_from_nodes(nodes, min_words=min_words), min_words)
    return rows.select("id", F.posexplode("segments").alias("segment", "s")).select("id", "segment", "s.begin", "s.words", "s.lang", "s.confidence")


def mislabelled(nodes: DataFrame, model: LanguageModel | None = None, min_words: int = 8) -> DataFrame:
    """id, lang: the languages of the text blocks of current nodes whose label is missing, says nothing or names
    another one, or which mix several. Blocks in a language not known here don't count."""
    known = F.filter("languages", lambda x: x != UNKNOWN)
    rows = node_languages(nodes, model, min_words).withColumn("languages", known).where(F.size("languages") > 0)
    wrong = F.col("label").isNull() | (F.size("languages") > 1) | (F.col("label") != F.col("languages")[0])
    return rows.where(wrong & F.col("id").isNotNull()).select("id", F.explode("languages").alias("lang")).distinct()
