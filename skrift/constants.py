"""Fixed values of the data format and of the ranking."""

# Party codes and names, in slot order.
PARTIES = {
    "S": "Socialdemokraterna", "M": "Moderaterna", "SD": "Sverigedemokraterna", "C": "Centerpartiet",
    "V": "Vänsterpartiet", "KD": "Kristdemokraterna", "MP": "Miljöpartiet", "L": "Liberalerna",
}
# Layers in slot order; only the government's parties get propositions.
LAYERS = ("program", "motion", "proposition", "said")
GOVERNMENT = ("M", "KD", "L")
# Ranking.
K1, B = 1.5, 0.75
RRF_K, WEIGHT_BM25, WEIGHT_VECTOR = 60, 0.35, 1.0
CANDIDATES = 300
# Passages and contexts.
MAX_CHARS, OVERLAP = 1200, 150
MAX_CONTEXT_CHARS = 40_000
ARGUMENT_CHARS = {"one_party": 1500, "several_parties": 600}
# Slots.
QUOTA = {"one_party": {"program": 3, "motion": 8, "proposition": 3, "said": 3}, "several_parties": {"program": 1, "motion": 2, "proposition": 2, "said": 1}}
MAX_DISTANCE, MIN_SIMILARITY, MIN_MATCH = 0.04, 0.80, 0.5
SLOT_EXTRA = 20
HISTORY_TURNS, TOOL_ROUNDS, MOST_INDIVIDUAL = 20, 2, 0
MIN_TEXT_CHARS, MIN_CHARS, HEAD_CHARS = 150, 150, 400_000

# Words that search ignores.
STOPWORDS = tuple(
    "och att det som en för av på är den till med de i om så har inte den där vi men kan ska har hade blir blev vara var vid ett den denna "
    "detta dessa under efter mot från utan även samt då när där vilket vilka man sig sin sitt dess deras våra vår vårt eller än mer mest "
    "också bara alla andra".split()
)
# Words that matching of proposals with sections ignores besides.
MATCH_STOPWORDS = (*STOPWORDS, *"bör detta riksdagen regeringen till känna ställer sig bakom anförs motionen".split())
# Party words that are dropped from a query with a party filter.
PARTY_WORDS = tuple(
    "s socialdemokraterna m moderaterna sd sverigedemokraterna c centerpartiet v vänsterpartiet kd kristdemokraterna mp miljöpartiet l liberalerna "
    "moderata samlingspartiet socialdemokrater sverigedemokrater kristdemokrater centern partiet".split()
)
# Suffixes of the stemmer, longest first, and the least stem.
SUFFIXES = "ernas arnas ornas andet arna erna orna ande ende aste ades ade are ast ens ets er ar or en et na as es".split()
MIN_STEM = 4
WORD = "[a-zåäöéA-ZÅÄÖÉ0-9]+"
MATCH_WORD = "[a-zåäöA-ZÅÄÖ0-9]+"
# Party aliases.
ALIASES = {
    "s": "S", "socialdemokraterna": "S", "socialdemokraterna s": "S", "sossarna": "S", "socialdemokratiska arbetarepartiet": "S",
    "m": "M", "moderaterna": "M", "moderata samlingspartiet": "M", "sd": "SD", "sverigedemokraterna": "SD",
    "c": "C", "centerpartiet": "C", "centern": "C", "v": "V", "vänsterpartiet": "V", "vansterpartiet": "V",
    "kd": "KD", "kristdemokraterna": "KD", "mp": "MP", "miljöpartiet": "MP", "miljopartiet": "MP",
    "l": "L", "liberalerna": "L", "folkpartiet": "L",
}
# Patterns of questions and answers.
VOTING_ADVICE = "vilket parti (ska|bör) jag|vilket parti är bäst|bästa partiet|passar mig|(ska|bör) jag rösta|rekommendera(r)? du|hjälp mig välja"
CITATION = r"\s*\[\d+(?:\s*[,–-]\s*\d+)*\]"
LIST_MARKER = r"^([-*•]|\d+\.)\s+"
TRAILING_CITATIONS = r"([.!?])((?:\s*\[\d+(?:\s*[,–-]\s*\d+)*\])+)"
LAYER_LABEL = r" ?\((?:PROGRAM|SAID|MOTION|PROPOSITION)\)"
GAP = (
    "saknas|finns (det )?(inget|inga|inte)|inget (relevant )?(material|underlag)|framgår inte|tar inte upp|hittade (inget|inga)|"
    "inte (något|någon|några) (material|underlag|information)|no (relevant )?(material|information|sources)|not (in|covered by) the material|"
    r"does not (contain|include|mention)|could not find|lacks?\b"
)
REFUSAL = (
    "rekommender|rangordna|ge (något |några )?råd|tar inte ställning|inte (säga|avgöra|tala om) vilket parti|recommend|advi[cs]e|"
    "not (tell|say) (you )?which party"
)
# How answers name the parties, in Swedish or English; case counts.
PARTY_NAMES_IN_ANSWERS = {
    "S": r"Socialdemokrat\w*|Social Democrat\w*",
    "M": r"Moderat\w*|Moderate\w*",
    "SD": r"Sverigedemokrat\w*|Sweden Democrat\w*",
    "C": r"Centerpartiet\w*|Centern\w*|Cent(?:re|er) Party",
    "V": r"Vänsterpartiet\w*|Left Party",
    "KD": r"Kristdemokrat\w*|Christian Democrat\w*",
    "MP": r"Miljöpartiet\w*|Green Party|the Greens",
    "L": r"Liberalerna\w*|Liberal Party|Liberals",
}
SWEDISH = "och att det som är inte för med har vill partiet de om sig".split()
ENGLISH = "the and to of is that not for with has wants party they it".split()
# What a prompt is made of.
LAYER_NAMES = {"said": "hemsidan", "motion": "motioner", "program": "partiprogrammet", "proposition": "propositioner"}
GAPS_TITLE = "INGET RELEVANT MATERIAL HITTADES FÖR"
ALL_SHOWN = "(Alla träffar i den här sökningen har redan visats ovan.)"
VOTING_ADVICE_NOTE = (
    "\n\nOBS: användaren ber om en partirekommendation. Följ regel 3 — rekommendera inte, förklara kort varför, och redovisa sedan neutralt "
    "vad partierna säger i sakfrågan, om frågan nämner någon.\n"
)
NO_ANSWER = "[no answer was generated — finish_reason: {}]"
CONFIGS = ("rag_tools", "rag_one_call", "no_rag")
