"""Term lists for the rule labels.

A ``Lexicon`` is a plain bundle of short lists. They end up as literals in the
plan (``IN`` over a hash set), so labelling is row-wise: no join, no shuffle.
"""

from dataclasses import dataclass, field


def _words(text: str) -> list[str]:
    return text.split()


# Function words by language; a word of several languages counts less for each.
FUNCTION_WORDS = {
    "en": _words("the and of to in is that it with for was are this be have not"),
    "de": _words("der die das und ist nicht mit den von zu ein eine im dem auf sich"),
    "fr": _words("le la les et des est un une dans que pour qui pas sur du au"),
    "es": _words("el la los las y de que en un una por con para se del no"),
    "hi": _words("है और का की के में से को नहीं यह"),
    "zh": [],
}

# Weight 2 marks strong words, weight 1 plain ones.
POSITIVE = {
    2: _words(
        "love excellent outstanding amazing fantastic proud thrilled "
        "hervorragend ausgezeichnet begeistert excellente formidable génial "
        "excelente fantástico encantado उत्कृष्ट शानदार"
    ),
    1: _words(
        "good great happy satisfied supportive valued appreciated helpful improved enjoy "
        "fair clear motivated tolle toll gut zufrieden hilfreich fair wertgeschätzt "
        "bon bonne heureux satisfait utile apprécié bueno buena feliz contento útil valorado "
        "अच्छा खुश संतुष्ट"
    ),
}
NEGATIVE = {
    2: _words(
        "terrible unbearable toxic unsustainable hate awful hostile burnout quit "
        "unerträglich katastrophal toxisch insupportable toxique catastrophique "
        "insoportable tóxico terrible भयानक असहनीय"
    ),
    1: _words(
        "bad poor stressed overwhelmed overwhelming unclear frustrated frustrating unfair "
        "ignored never lack exhausted disappointed schlecht überlastet unklar frustriert "
        "unfair enttäuscht mauvais stressé épuisé injuste frustré déçu malo estresado "
        "agotado injusto frustrado decepcionado खराब तनाव निराश"
    ),
}
POSITIVE_HAN = ["喜欢", "优秀", "满意", "很好", "支持"]
NEGATIVE_HAN = ["压力", "加班", "不满", "糟糕", "疲惫"]

THEME_TERMS = {
    "workload_balance": _words(
        "workload overtime hours deadline deadlines balance weekend arbeitslast überstunden "
        "balance charge heures carga horas काम 加班 工作量"
    ),
    "management_leadership": _words(
        "manager management leader leadership boss feedback führung chef vorgesetzter "
        "direction responsable jefe liderazgo प्रबंधक 经理 领导 管理"
    ),
    "recognition_rewards": _words(
        "recognition reward rewards bonus salary pay praise anerkennung gehalt "
        "reconnaissance salaire reconocimiento salario वेतन 奖励 薪资"
    ),
    "career_growth": _words(
        "career growth promotion development training karriere entwicklung beförderung "
        "carrière promotion formation carrera desarrollo promoción विकास 晋升 培训 职业"
    ),
    "team_collaboration": _words(
        "team teams colleagues collaboration teamwork teamarbeit kollegen équipe "
        "collègues collaboration equipo compañeros टीम 团队 同事"
    ),
    "company_strategy": _words(
        "strategy vision goals roadmap company strategie ziele stratégie objectifs "
        "estrategia objetivos रणनीति 战略 目标"
    ),
    "tools_resources": _words(
        "tools equipment software laptop resources office werkzeuge ausstattung outils "
        "matériel bureau herramientas recursos oficina उपकरण 工具 设备"
    ),
    "inclusion_belonging": _words(
        "inclusion diversity belonging inclusive equality bias vielfalt zugehörigkeit "
        "diversité inclusion diversidad inclusión समावेश 包容 平等"
    ),
    "wellbeing_safety": _words(
        "wellbeing health stress safety burnout mental gesundheit sicherheit santé "
        "sécurité salud seguridad bienestar स्वास्थ्य 健康 安全"
    ),
    "communication": _words(
        "communication information transparency meeting meetings kommunikation "
        "transparenz information réunion transparence comunicación transparencia संचार 沟通 会议"
    ),
}

EMOTION_TERMS = {
    "exhausted": _words("exhausted exhausting erschöpft épuisé agotado 疲惫"),
    "overwhelmed": _words("overwhelmed overwhelming überlastet überfordert débordé abrumado"),
    "frustrated": _words("frustrated frustrating frustriert frustré frustrado 沮丧"),
    "burned out": _words("burnout ausgebrannt"),
    "stressed": _words("stressed stressful gestresst stressé estresado तनाव 压力"),
    "undervalued": _words("undervalued unappreciated"),
    "ignored": _words("ignored unheard ignoriert ignoré ignorado"),
    "hopeless": _words("hopeless hoffnungslos"),
    "anxious": _words("anxious worried besorgt inquiet ansioso"),
    "disengaged": _words("disengaged bored gelangweilt"),
    "supported": _words("supported supportive unterstützt soutenu apoyado 支持"),
    "motivated": _words("motivated motivating motiviert motivé motivado"),
    "appreciated": _words("appreciated wertgeschätzt apprécié"),
    "engaged": _words("engaged engagiert engagé"),
    "hopeful": _words("hopeful optimistic hoffnungsvoll"),
    "satisfied": _words("satisfied zufrieden satisfait contento संतुष्ट 满意"),
    "valued": _words("valued valorado valorisé"),
    "energized": _words("energized energised"),
    "happy": _words("happy glücklich heureux feliz खुश"),
    "proud": _words("proud stolz fier orgulloso"),
}

# Phrases that say someone means to go.
LEAVING = [
    r"looking for (?:a|another) (?:new )?job", r"thinking (?:of|about) leaving",
    r"going to (?:quit|resign)", r"(?:hand|handed) in my notice", r"want to (?:quit|leave)",
    r"k[üu]ndig(?:en|ung)", r"d[ée]missionner", r"renunciar",
    r"इस्तीफ", r"辞职", r"离职",
]


@dataclass(frozen=True)
class Lexicon:
    positive: dict[int, list[str]] = field(default_factory=lambda: POSITIVE)
    negative: dict[int, list[str]] = field(default_factory=lambda: NEGATIVE)
    positive_han: list[str] = field(default_factory=lambda: POSITIVE_HAN)
    negative_han: list[str] = field(default_factory=lambda: NEGATIVE_HAN)
    themes: dict[str, list[str]] = field(default_factory=lambda: THEME_TERMS)
    emotions: dict[str, list[str]] = field(default_factory=lambda: EMOTION_TERMS)
    leaving: list[str] = field(default_factory=lambda: LEAVING)
    function_words: dict[str, list[str]] = field(default_factory=lambda: FUNCTION_WORDS)

    @property
    def stop_words(self) -> list[str]:
        return sorted({w for words in self.function_words.values() for w in words})


DEFAULT = Lexicon()
