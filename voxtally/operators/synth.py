"""Synthetic answers from a weighted grammar: every draw is a hash of an id and of the place in the
grammar where it is made, so a rerun gives the same rows and nothing repeats after some number of ids.

A grammar has for each symbol its alternatives, a weight and a list of parts, which are words or symbols
in angle brackets. Which alternative an answer takes is drawn once for each place that the symbol
can stand in."""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxtally import constants as K
from voxtally.functions.draws import hashed, pick, weighted
from voxtally.functions.text import strings

# Opening by language and sentiment; %s takes the theme in that language.
OPENINGS = {
    "en": ["I am thrilled with %s here.", "I am quite happy with %s.", "There is little to say about %s.",
           "I am disappointed by %s.", "The state of %s is unbearable, I am thinking of leaving."],
    "de": ["Ich bin begeistert von %s.", "Ich bin zufrieden mit %s.", "Zu %s gibt es wenig zu sagen.",
           "Ich bin enttäuscht von %s.", "Der Zustand bei %s ist unerträglich, ich werde kündigen."],
    "fr": ["Je suis ravi de %s.", "Je suis satisfait de %s.", "Il y a peu à dire sur %s.",
           "Je suis déçu par %s.", "La situation de %s est insupportable, je vais démissionner."],
    "es": ["Estoy encantado con %s.", "Estoy contento con %s.", "Hay poco que decir sobre %s.",
           "Estoy decepcionado con %s.", "La situación de %s es insoportable, voy a renunciar."],
    "hi": ["मैं %s से बहुत खुश हूँ।", "मैं %s से संतुष्ट हूँ।", "%s के बारे में कहने को कम है।",
           "मैं %s से निराश हूँ।", "%s की हालत असहनीय है, मैं इस्तीफ़ा दूँगा।"],
    "zh": ["我非常喜欢这里的%s。", "我对%s比较满意。", "关于%s没什么可说的。",
           "我对%s感到失望。", "%s的情况很糟糕，我想辞职。"],
}
# Theme names by language, in theme order.
SUBJECTS = {
    "en": ["the workload", "my manager", "the recognition", "my career path", "our team",
           "the company strategy", "our tools", "the inclusion", "the care for our health",
           "the internal communication"],
    "de": ["der Arbeitslast", "meinem Chef", "der Anerkennung", "meiner Karriere", "unserem Team",
           "der Strategie", "unseren Werkzeugen", "der Vielfalt", "der Sorge um unsere Gesundheit",
           "der Kommunikation"],
    "fr": ["la charge de travail", "mon responsable", "la reconnaissance", "ma carrière",
           "notre équipe", "la stratégie", "nos outils", "la diversité", "notre santé",
           "la communication"],
    "es": ["la carga de trabajo", "mi jefe", "el reconocimiento", "mi carrera", "nuestro equipo",
           "la estrategia", "nuestras herramientas", "la diversidad", "nuestra salud",
           "la comunicación"],
    "hi": ["काम", "प्रबंधक", "वेतन", "विकास", "टीम", "रणनीति", "उपकरण", "समावेश", "स्वास्थ्य", "संचार"],
    "zh": ["工作量", "经理", "奖励", "职业发展", "团队", "公司战略", "工具", "包容", "健康", "沟通"],
}
# Closing by language and place in the batch.
CLOSINGS = {
    "en": ["That is my view.", "My colleagues say the same.", "It has been so all year.",
           "I hope this is read.", "Ask us again next quarter."],
    "de": ["Das ist meine Sicht.", "Meine Kollegen sagen dasselbe.", "So war es das ganze Jahr.",
           "Ich hoffe, das wird gelesen.", "Fragt uns im nächsten Quartal wieder."],
    "fr": ["C'est mon avis.", "Mes collègues disent pareil.", "C'est ainsi toute l'année.",
           "J'espère que ce sera lu.", "Reposez la question au prochain trimestre."],
    "es": ["Es mi opinión.", "Mis compañeros dicen lo mismo.", "Ha sido así todo el año.",
           "Espero que se lea.", "Pregunten otra vez el próximo trimestre."],
    "hi": ["यह मेरी राय है।", "मेरे साथी भी यही कहते हैं।", "पूरे साल ऐसा ही रहा।",
           "आशा है इसे पढ़ा जाएगा।", "अगली तिमाही में फिर पूछें।"],
    "zh": ["这是我的看法。", "同事们也这么说。", "全年都是这样。", "希望有人会看。", "请下个季度再问。"],
}


# What an answer may add between its opening and its closing, by language.
REASONS = {
    "en": ["<since> it has changed a lot.", "<who> talks about it often.", "We spoke about it <since>.",
           "It takes up much of my week.", "Nobody asked <who> about it.", "I see the effect every day.",
           "My last project showed it clearly.", "<who> noticed it <since>."],
    "de": ["<since> hat sich viel geändert.", "<who> spricht oft darüber.", "Wir sprachen <since> darüber.",
           "Es nimmt viel von meiner Woche ein.", "Niemand hat danach gefragt.", "Ich sehe die Wirkung jeden Tag.",
           "Mein letztes Projekt hat es deutlich gezeigt.", "<who> hat es <since> bemerkt."],
    "fr": ["<since> cela a beaucoup changé.", "<who> en parle souvent.", "Nous en avons parlé <since>.",
           "Cela occupe une bonne partie de ma semaine.", "Personne ne pose la question.",
           "J'en vois l'effet chaque jour.", "Mon dernier projet l'a bien montré.", "<who> l'a remarqué <since>."],
    "es": ["<since> ha cambiado mucho.", "<who> habla de ello a menudo.", "Hablamos de ello <since>.",
           "Ocupa buena parte de mi semana.", "Nadie pregunta por ello.", "Veo el efecto cada día.",
           "Mi último proyecto lo mostró con claridad.", "<who> lo notó <since>."],
    "hi": ["<since> बहुत कुछ बदला है।", "<who> अक्सर इसकी बात करता है।", "हमने <since> इस पर बात की।",
           "मेरे हफ़्ते का बड़ा हिस्सा इसमें जाता है।", "किसी ने इसके बारे में नहीं पूछा।", "असर रोज़ दिखता है।",
           "मेरी पिछली परियोजना में यह साफ़ दिखा।", "<who> ने <since> यह देखा।"],
    "zh": ["<since>变化很大。", "<who>常常谈到这件事。", "我们<since>谈过这件事。", "它占用了我一周的很多时间。",
           "没有人问过这件事。", "我每天都看得到影响。", "我上一个项目说明了这一点。", "<who><since>注意到了。"],
}
SINCE = {
    "en": ["since last spring", "in the past months", "since the move", "in recent weeks", "after the merger", "this year"],
    "de": ["seit dem Frühjahr", "in den letzten Monaten", "seit dem Umzug", "in den letzten Wochen", "nach der Fusion", "in diesem Jahr"],
    "fr": ["depuis le printemps", "ces derniers mois", "depuis le déménagement", "ces dernières semaines", "après la fusion", "cette année"],
    "es": ["desde la primavera", "en los últimos meses", "desde la mudanza", "en las últimas semanas", "tras la fusión", "este año"],
    "hi": ["वसंत से", "पिछले महीनों में", "दफ़्तर बदलने के बाद से", "हाल के हफ़्तों में", "विलय के बाद", "इस साल"],
    "zh": ["从春天起", "这几个月", "搬家以后", "最近几周", "合并之后", "今年"],
}
WHO = {
    "en": ["the whole floor", "my neighbour at work", "a new colleague", "the night shift"],
    "de": ["die ganze Etage", "mein Nachbar im Büro", "ein neuer Kollege", "die Nachtschicht"],
    "fr": ["tout l'étage", "mon voisin de bureau", "un nouveau collègue", "l'équipe de nuit"],
    "es": ["toda la planta", "mi vecino de mesa", "un compañero nuevo", "el turno de noche"],
    "hi": ["पूरा विभाग", "मेरा पड़ोसी", "एक नया साथी", "रात की पाली"],
    "zh": ["整个楼层", "我的邻座", "一位新同事", "夜班"],
}


#: Of ten answers, how many have no reason, one, and two; weights of the alternatives of <since>.
REASON_WEIGHTS, SINCE_WEIGHTS = [2, 5, 3], [6, 5, 4, 3, 2, 1]


def chosen(drawn: Column, weights: list[int]) -> Column:
    """The place among ``weights`` in which a draw below their sum falls."""
    upto, out = 0, F
    for place, weight in enumerate(weights):
        upto += weight
        out = out.when(drawn < upto, place)
    return out


def synthesize(base: DataFrame, seed_id: str = "id", batch: int = K.SYNTH_BATCH) -> DataFrame:
    """One answer per language for every row of ``base``, whose ids count from 0.

    Rows of a batch share theme, sentiment and department. Ids carry a counter that runs
    through the languages. Row-wise but for the number of rows.
    """
    languages = list(K.LANGUAGES)
    total = base.agg(F.count(F.lit(1)))
    rows = base.select(
        F.col(seed_id).cast("long").alias("row"),
        F.explode(F.sequence(F.lit(0), F.lit(len(languages) - 1))).alias("li"),
    ).withColumn("_total", total.scalar())
    # Batches of all languages are told apart by a stride no batch number reaches twice.
    group = F.floor(F.col("row") / batch).cast("long") * len(languages) + F.col("li")
    drawn = rows.withColumn("g", group).withColumns({
        "language": pick(languages, F.col("li")),
        "theme_no": hashed("g", "theme", len(K.THEMES)),
        "declared_sentiment": weighted(K.SENTIMENT_PERCENT, hashed("g", "sentiment", 100)),
        "department": pick(K.DEPARTMENTS, hashed("g", "department", len(K.DEPARTMENTS))),
        "counter": F.col("li") * F.col("_total") + F.col("row"),
    }).withColumns({
        "survey_theme": pick(list(K.THEMES), F.col("theme_no")),
        "experience": pick(
            K.EXPERIENCE_LEVELS, hashed("counter", "experience", len(K.EXPERIENCE_LEVELS))
        ),
    })
    return drawn.withColumn("text", _text()).select(
        F.format_string("%s_%05d", "language", "counter").alias("response_id"),
        "text", "language", "declared_sentiment", "survey_theme", "department", "experience",
    )


def _nested(table: dict[str, list[str]], row, column):
    cells = F.array(*[strings(table[lang]) for lang in K.LANGUAGES])
    return F.get(F.get(cells, row), column)


def _text():
    sentiment_no = F.array_position(
        strings(K.SENTIMENTS), F.col("declared_sentiment")
    ).cast("int") - 1
    place = (F.col("row") % K.SYNTH_BATCH).cast("int")
    opening = F.replace(
        _nested(OPENINGS, F.col("li"), sentiment_no), F.lit("%s"),
        _nested(SUBJECTS, F.col("li"), F.col("theme_no")),
    )
    gap = F.when(F.col("language") == "zh", "").otherwise(" ")
    many = chosen(hashed("counter", "answer", sum(REASON_WEIGHTS)), REASON_WEIGHTS)

    def reason(nth: int) -> Column:
        since = chosen(hashed("counter", f"reason{nth}.since", sum(SINCE_WEIGHTS)), SINCE_WEIGHTS)
        filled = _nested(REASONS, F.col("li"), hashed("counter", f"reason{nth}", len(REASONS["en"])))
        for symbol, text in (
            ("<since>", _nested(SINCE, F.col("li"), since)),
            ("<who>", _nested(WHO, F.col("li"), hashed("counter", f"reason{nth}.who", len(WHO["en"])))),
        ):
            filled = F.replace(filled, F.lit(symbol), text)
        return F.when(many >= nth, F.concat(gap, filled)).otherwise("")

    return F.concat(opening, reason(1), reason(2), gap, _nested(CLOSINGS, F.col("li"), place))


def dataset(spark: SparkSession, per_language: int = K.SYNTH_PER_LANGUAGE) -> DataFrame:
    return synthesize(spark.range(per_language))
