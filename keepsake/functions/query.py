"""What a question asks for: terms, intent, specificity, types, scope. All are column expressions over its text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import unit
from .text import is_one_of, let, literals, trimmed, words_of

#: Words that are no terms.
STOPWORDS = tuple(
    "a an the is are was were be been being have has had do does did will would could should may might can shall must in on at to for of with by from about into through during before after above below between under again further then once i me my we our you your he she it they them this that these those and but or nor not so yet if when where how what which who whom all each every both few more most other some such no any only own same than too very just also now tell give show find get make let".split()
)
#: Words of each intent, in order of precedence.
INTENTS = {
    "recall": ("what", "remember", "recall", "did i", "what was", "what did", "told", "said", "mentioned"),
    "compare": ("compare", "versus", "vs", "difference", "better", "worse", "prefer", "which"),
    "build_on": ("based on", "building on", "extending", "next step", "continue", "follow up", "related to"),
    "verify": ("is it true", "confirm", "verify", "correct", "accurate", "actually", "really"),
    "explore": ("tell me about", "explain", "describe", "what is", "how does", "how do", "what are", "elaborate"),
    "summarize": ("summarize", "summary", "overview", "main points", "key takeaways", "tldr"),
    "debug": ("error", "bug", "issue", "problem", "broken", "fix", "wrong", "fail", "crash"),
    "explain": ("why", "how", "explain", "reason", "cause", "because"),
}
#: Small talk, as whole messages of up to 48 characters.
CHITCHAT = (
    r"(?i)^\s*(hi|hello|hey|howdy|yo|sup|hiya|greetings|hola|hey\s+there|hello\s+there)\s*[!.?,]*\s*$",
    r"(?i)^\s*how\s+are\s+you\s*[?.!]*\s*$",
    r"(?i)^\s*how\s+are\s+ya\s*[?.!]*\s*$",
    r"(?i)^\s*how\s+are\s+things\s*[?.!]*\s*$",
    r"(?i)^\s*how('?s| is) it going\s*[?.!]*\s*$",
    r"(?i)^\s*how do you do\s*[?.!]*\s*$",
    r"(?i)^\s*what'?s up\s*[?.!]*\s*$",
    r"(?i)^\s*what'?s good\s*[?.!]*\s*$",
    r"(?i)^\s*(good|great|lovely)\s+(morning|afternoon|evening|night)\s*[?.!]*\s*$",
    r"(?i)^\s*(thanks|thank you|thanku|thx|ty|cheers|appreciate it|ta)\s*[!.?,]*\s*$",
    r"(?i)^\s*(bye|goodbye|see ya|see you|later|ciao|take care)\s*[!.?,]*\s*$",
    r"(?i)^\s*(who|what) are you\s*[?.!]*\s*$",
    r"(?i)^\s*(ok|okay|k|cool|got it|gotcha|understood|nice|great|awesome|sweet|perfect|sure|yep|yeah|nope|no)\s*[!.?,]*\s*$",
)
#: Phrases of questions about a whole.
ABSTRACT_PHRASES = (
    "connect the dots", "connections between", "how do they connect", "how does it all connect", "links between", "tie together", "my notes", "my documents", "my files", "my uploads", "my papers", "everything i have", "everything you know", "what do you know", "what do you remember", "what is in my", "all my",
    "main contribution", "main contributions", "primary contribution", "key contribution", "what problem does it solve", "what problem does this solve", "what problems does it solve", "what does it solve", "what are the results", "what results does it", "what were the results", "experimental results",
    "main idea", "main ideas", "main point", "main points", "main topic", "main topics", "key idea", "key ideas", "key finding", "key findings", "key takeaway", "key takeaways", "summary", "summarize", "overview", "what is this document about", "what is this paper about", "what is this file about", "what is this about",
    "what does this document cover", "what does this paper cover", "what does this file cover", "what does this cover", "purpose", "thesis", "argument", "conclusion", "conclusions", "most important", "important findings", "core idea", "core message", "big picture", "high level", "what matters", "what changed", "what did we discuss",
    "decisions made", "lesson", "lessons", "takeaway", "takeaways",
)
#: Terms that stand with a phrase, in order.
EXPANSIONS = {
    "main contribution": ("significance", "contribution", "novel", "proposes", "introduces", "primary achievement", "presents", "argues", "thesis", "purpose"),
    "contribution": ("significance", "novel", "proposes", "introduces", "primary achievement", "presents", "argues"),
    "problem": ("issue", "challenge", "obstacle", "difficulty", "limitation", "solves", "addresses"),
    "problems": ("issue", "challenge", "obstacle", "difficulty", "limitation"),
    "solve": ("resolve", "address", "fix", "mitigate", "handle"),
    "solves": ("resolve", "address", "fix", "mitigate", "handle"),
    "results": ("findings", "outcomes", "evaluation", "metrics", "performance", "experimental results", "benchmark", "throughput", "accuracy", "latency"),
    "result": ("findings", "outcomes", "evaluation", "metrics", "performance", "experimental results", "benchmark", "throughput", "accuracy", "latency"),
    "findings": ("results", "outcomes", "evaluation", "metrics", "performance"),
    "performance": ("benchmark", "metric", "throughput", "latency", "accuracy", "speed", "evaluation"),
    "key finding": ("finding", "result", "discovery", "outcome", "significant", "evaluation"),
    "important": ("significance", "important", "critical", "key", "major"),
    "core idea": ("concept", "idea", "principle", "fundamental", "core"),
    "what is this about": ("overview", "purpose", "summary", "about", "main topic", "presents", "describes", "covers"),
    "what does this document cover": ("overview", "covers", "topics", "sections", "summary", "scope"),
    "how it works": ("mechanism", "process", "method", "approach", "architecture"),
    "architecture": ("design", "structure", "component", "system", "infrastructure"),
    "what did we discuss": ("conversation", "discussion", "talked about", "discussed"),
    "decisions made": ("decision", "chose", "selected", "decided", "agreed"),
    "summary": ("overview", "recap", "synthesis", "condensed", "presents", "main points"),
    "takeaways": ("takeaway", "lesson", "insight", "conclusion", "learning"),
    "lesson": ("lesson", "teaches", "principle", "rule", "concept", "takeaway"),
    "thesis": ("thesis", "argument", "claim", "position", "stance", "presents"),
    "document": ("document", "paper", "file", "text", "section", "source"),
    "what problem does it solve": ("issue", "challenge", "gap", "limitation", "solves", "addresses"),
    "what results does it report": ("findings", "outcomes", "evaluation", "metrics", "performance", "benchmark", "throughput", "accuracy"),
}
#: Broad questions, questions on one document, questions on the archive.
BROAD = (r"(?i)^(what|tell me|explain|describe|summarize)\s", r"(?i)^(what is|what are|what was)\s+(this|that|the)\s+(about|document|paper|text|book|file|report|article)", r"(?i)\b(main|key|important|core|primary)\s+(contribution|finding|idea|point|concept|topic|lesson|takeaway|result|results)\b", r"(?i)\b(overview|summary|tldr|recap)\b", r"(?i)^(how does|how do|how did)\s", r"(?i)\bwhat\s+(problem|issue|challenge)\b", r"(?i)\bwhat\s+(results|findings|outcomes)\b")
SCOPED = (r"(?i)\b(this|that|the current|the uploaded|the attached|the given)\s+(document|paper|file|pdf|text|article|report|book|section|page)\b", r"(?i)\bfrom\s+the\s+(document|paper|file|pdf|text|article|report|book)\b", r"(?i)\baccording\s+to\s+the\s+(document|paper|file|text|article|report|book)\b", r"(?i)\bdocument\s+scoped\b", r"(?i)\bwithin\s+the\s+(document|paper|file|text)\b", r"(?i)\buploaded\s+(document|file|pdf)\b", r"(?i)\bthe\s+(document|paper|file|pdf)\b")
ARCHIVE = (
    r"(?i)\bwhat\s+(papers?|documents?|docs?|files?|books?)\b", r"(?i)\b(which|list|show)\s+(my|the|all)\s+(papers?|documents?|docs?|files?|uploads?|books?)\b", r"(?is)\b(my|the|all|any)\s+(papers?|documents?|docs?|files?|uploads?|books?)\b.{0,60}\b(have|hold|contains?|stored?|uploaded|include)\b", r"(?i)\b(have|hold|contain|include)\s+(you|the\s+archive)\b",
    r"(?i)\bhow\s+many\s+(papers?|documents?|docs?|files?|memories?|books?)\b", r"(?i)\bin\s+(my|the)\s+(archive|knowledge\s*base)\b", r"(?i)\bwhat\s+do\s+(you|we)\s+have\b", r"(?is)\b(summarize|summary|overview)\b.{0,30}\b(my|the|all)\b.{0,30}(papers?|documents?|docs?|files?|uploads?|books?|archive)\b", r"(?i)\babout\s+(my|the)\s+(papers?|documents?|docs?|files?|books?|archive)\b",
)
#: Words that ask for a type, and the types of an intent without any.
TYPE_WORDS = {"problem": "error|bug|issue|problem|fail|crash|broken", "decision": "decision|chose|decided|selected|prefer|switch|migrate", "fact": "fact|data|metric|number|stat|measurement", "entity": "who|person|company|organization|tool|library|framework", "event": "when|event|happened|occurred|timeline", "preference": "prefer|like|dislike|opinion|taste", "code": "code|function|api|endpoint|implementation|class|module"}
INTENT_TYPES = {"debug": ("problem", "code"), "compare": ("decision", "fact"), "verify": ("fact", "decision"), "build_on": ("decision", "code", "fact")}
#: Words of the domains a question may be about, in order of precedence.
DOMAIN_WORDS = {
    "computer-science": ("code", "api", "algorithm", "database", "function", "class", "bug", "deploy", "server", "typescript", "python", "react", "node", "project", "worker", "github"),
    "medicine": ("patient", "symptom", "treatment", "diagnosis", "drug", "clinical", "therapy", "medical"),
    "law": ("legal", "contract", "statute", "court", "liability", "regulation", "law"),
    "business": ("revenue", "market", "strategy", "customer", "profit", "roi", "kpi", "competitor", "money", "investing", "financial", "income", "wealth", "tax"),
    "biology": ("gene", "protein", "cell", "organism", "evolution", "dna", "enzyme"),
    "physics": ("quantum", "particle", "energy", "force", "gravity", "wave", "field"),
    "chemistry": ("molecule", "reaction", "compound", "element", "bond", "catalyst"),
    "mathematics": ("theorem", "proof", "equation", "formula", "integral", "matrix"),
    "engineering": ("design", "specification", "circuit", "structural", "tolerance", "prototype"),
    "humanities": ("history", "culture", "philosophy", "literature", "society", "art"),
}
#: Terms that questions about results, contributions and problems look for.
RESULT_TERMS = ("results", "result", "metrics", "metric", "performance", "benchmark", "evaluation", "outcome", "findings", "throughput", "latency", "accuracy", "speedup", "improvement", "baseline", "comparison", "experiment")
MAIN_TERMS = ("contribution", "contributions", "main", "novel", "proposes", "introduces", "presents", "primary", "core", "thesis", "purpose", "architecture", "system", "method", "module", "framework")
PROBLEM_TERMS = ("problem", "issue", "challenge", "gap", "limitation", "solve", "solves", "address", "addresses", "bottleneck", "inefficiency", "overhead")
RESULTS_ASKED = "(?i)(result|metric|performance|benchmark|evaluation|outcome|findings|throughput|latency|accuracy|speedup|improvement|baseline|comparison|experiment|table)"
MAIN_ASKED = "(?i)(contribution|main idea|main point|main topic|what is this|what does this|about|purpose|thesis|novel|proposes|introduces|presents|core idea|primary)"
PROBLEM_ASKED = "(?i)(problem|issue|challenge|gap|limitation|solve|address|bottleneck|inefficiency|overhead)"


def any_of(text: Column, patterns) -> Column:
    return reduce(Column.__or__, (text.rlike(p) for p in patterns))


def contains_any(text: Column, parts) -> Column:
    return text.rlike("|".join(parts))


def is_chitchat(text: Column) -> Column:
    t = trimmed(text)
    return F.length(t).between(1, 48) & any_of(t, CHITCHAT)


def key_terms(text: Column, most: int = 10) -> Column:
    """Distinct words of three letters and more that are no stopwords, then distinct pairs of neighbours among them."""
    usable = F.filter(words_of(F.regexp_replace(F.lower(text), r"[^a-z0-9\s-]", "")), lambda w: (F.length(w) > 2) & ~is_one_of(w, STOPWORDS))

    def terms(words: Column) -> Column:
        """Pairs are only made where the words alone are too few, and then of few words."""

        def with_pairs(single: Column) -> Column:
            pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, 2)))
            return F.when((F.size(single) >= most) | (F.size(words) < 2), F.slice(single, 1, most)).otherwise(F.slice(F.concat(single, F.array_distinct(pairs)), 1, most))

        return let(F.array_distinct(words), with_pairs)

    return let(usable, terms)


def phrase_terms(text: Column) -> Column:
    """Terms of the phrases that the text has."""
    low = F.lower(text)
    return F.flatten(F.array(*(F.when(F.contains(low, F.lit(k)), literals(v)).otherwise(F.array().cast("array<string>")) for k, v in EXPANSIONS.items())))


def expanded_terms(text: Column, terms: Column, most: int = 8) -> Column:
    """Phrase terms, then each term's other number and its stem."""
    single = F.filter(terms, lambda t: ~F.contains(t, F.lit(" ")) & (F.length(t) >= 4))
    shorter = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)
    forms = F.flatten(F.transform(single, lambda t: F.array_compact(F.array(F.when(F.endswith(t, F.lit("s")), shorter(t, 1)).otherwise(F.concat(t, F.lit("s"))), F.when(F.endswith(t, F.lit("ing")), shorter(t, 3)), F.when(F.endswith(t, F.lit("ed")), shorter(t, 2))))))
    usable = F.filter(F.concat(phrase_terms(text), forms), lambda t: (F.length(t) >= 3) & ~is_one_of(t, STOPWORDS))
    return F.slice(F.array_distinct(usable), 1, most)


def intent(text: Column) -> Column:
    """The first intent one of whose words begins the text or stands in it; a question without any explores."""
    low = trimmed(F.lower(text))
    out = F.when(is_chitchat(text), "chitchat")
    for name, words in INTENTS.items():
        either = "|".join(words)
        out = out.when(low.rlike(f"^(?:{either})| (?:{either}) "), name)
    return out.when(F.endswith(low, F.lit("?")), "explore").otherwise("recall")


def is_abstract(text: Column) -> Column:
    low = F.lower(text)
    return contains_any(low, ABSTRACT_PHRASES) | any_of(text, BROAD) | contains_any(low, EXPANSIONS)


def is_scoped(text: Column) -> Column:
    return any_of(text, SCOPED)


def is_archive_question(text: Column) -> Column:
    return any_of(text, ARCHIVE)


def specificity(text: Column) -> Column:
    """Share of words with meaning, more for names, quotes and numbers, less for broad questions."""
    words = words_of(F.lower(text))
    share = F.when(F.size(words) > 0, F.size(F.filter(words, lambda w: ~is_one_of(w, STOPWORDS))) / F.size(words)).otherwise(0.0)
    # word boundaries of ASCII, as the JVM's are those of all letters
    names = F.regexp_count(text, F.lit(r"(?<![A-Za-z0-9_])[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*(?![A-Za-z0-9_])")) * 0.1
    raw = unit(share + names + F.when(text.rlike("\"[^\"]+\"|'[^']+'"), 0.15).otherwise(0.0) + F.when(text.rlike(r"\b[0-9]+(?:\.[0-9]+)?%?\b"), 0.1).otherwise(0.0) - F.when(any_of(text, BROAD), 0.2).otherwise(0.0))
    return F.when(is_chitchat(text), 0.0).when(is_abstract(text) | is_scoped(text), F.least(raw, F.lit(0.45))).otherwise(raw)


def preferred_types(text: Column, of_intent: Column, most: int = 4) -> Column:
    low = F.lower(text)
    asked = F.array_compact(F.array(*(F.when(low.rlike(rf"\b({words})\b"), name) for name, words in TYPE_WORDS.items())))
    usual = reduce(lambda c, x: c.when(of_intent == x[0], literals(x[1])), INTENT_TYPES.items(), F.when(F.lit(False), F.array().cast("array<string>"))).otherwise(literals(("fact", "entity", "decision")))
    return F.slice(F.when(F.size(asked) > 0, asked).otherwise(usual), 1, most)


def query_domain(text: Column) -> Column:
    """The domain most of whose words occur, two at least; the earlier one at a tie."""
    low = F.lower(text)
    scores = F.array(*(F.size(F.filter(literals(ws), lambda w: F.contains(low, w))) for ws in DOMAIN_WORDS.values()))
    return let(scores, lambda s: F.when(F.array_max(s) >= 2, F.element_at(literals(DOMAIN_WORDS), F.array_position(s, F.array_max(s)).cast("int"))).otherwise("general"))


def target_terms(text: Column, most: int = 12) -> Column:
    """Terms looked for by questions about results, contributions and problems."""
    none = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.flatten(F.array(*(F.when(text.rlike(p), literals(ts)).otherwise(none) for p, ts in ((RESULTS_ASKED, RESULT_TERMS), (MAIN_ASKED, MAIN_TERMS), (PROBLEM_ASKED, PROBLEM_TERMS)))))), 1, most)


def search_terms(terms: Column) -> Column:
    """Distinct terms fit for a LIKE pattern: no wildcards, two characters at least."""
    return F.array_distinct(F.filter(F.transform(terms, lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[%_\\]", " "), r"\s+", " "))), lambda t: F.length(t) >= 2))


def analysed(questions, text: str = "text"):
    """A question's analysis as columns."""
    t = F.col(text)
    quiet = is_chitchat(t)
    none = F.array().cast("array<string>")
    out = questions.withColumns({"is_chitchat": quiet, "intent": intent(t), "key_terms": F.when(quiet, none).otherwise(key_terms(t)), "specificity": specificity(t), "is_abstract": ~quiet & is_abstract(t), "document_scoped": ~quiet & is_scoped(t), "is_archive_question": ~quiet & is_archive_question(t), "domain": F.when(quiet, "general").otherwise(query_domain(t))})
    return out.withColumns({"expanded_terms": F.when(quiet, none).otherwise(expanded_terms(t, F.col("key_terms"))), "preferred_types": F.when(quiet, none).otherwise(preferred_types(t, F.col("intent")))})


#: Phrases in a reply that confirm, that bring something new, and what leads to a hint.
CONFIRMING = (
    "as you mentioned", "as we discussed", "you are right", "that is correct", "exactly", "as you said", "you're right", "that's right", "indeed", "correct", "as i recall", "based on what you told me", "building on your point",
    "as you pointed out", "remember when", "like you said", "per your note", "from our previous conversation", "as noted", "as established", "continuing from", "to follow up", "following up on",
)
NEWS = ("new information", "update", "correction", "actually", "turns out", "i realized", "changed my mind", "new approach", "different from", "correction:", "update:", "note:", "important:", "btw", "by the way")
HINTS = {"action_requested": ("should i", "want me to"), "reminder_requested": ("remind me", "remind you"), "explicit_save": ("save this", "remember this"), "emphasis_save": ("don't forget", "do not forget"), "future_reference": ("next time", "in the future")}
TOPICS = (r"(?:about|regarding|concerning|on the topic of|when it comes to)\s+([A-Z][a-zA-Z\s]{2,30})", r"(?:discussed|talked about|mentioned|covered)\s+([A-Z][a-zA-Z\s]{2,30})", r"(?:the\s+)?([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)?)\s+(?:project|system|approach|method|framework)")


def topics(text: Column, most: int = 10) -> Column:
    found = F.flatten(F.array(*(F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in TOPICS)))
    return F.slice(F.array_distinct(F.filter(F.transform(found, trimmed), lambda x: F.length(x).between(2, 50))), 1, most)


def confirmed(text: Column, labels: Column) -> Column:
    """Labels that a reply names, if it confirms anything."""
    low = F.lower(text)
    named = F.filter(labels, lambda x: F.contains(low, F.lower(x)) | F.contains(low, F.replace(F.lower(x), F.lit("_"), F.lit(" "))))
    return F.when(contains_any(low, CONFIRMING), named).otherwise(F.array().cast("array<string>"))


def reply_signs(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    news = contains_any(low, NEWS)
    hints = F.array_compact(F.array(*(F.when(contains_any(low, ps), name) for name, ps in HINTS.items())))
    return {"confirms": contains_any(low, CONFIRMING), "has_news": news, "hints": hints, "topics": topics(text), "reingest": news | (F.size(words_of(text)) > 20)}


def is_follow_up(text: Column) -> Column:
    return text.rlike(r"(?i)\b(it|this|that|these|the document|the paper|the file|the book|again|more|overview|summary|summarize|read)\b")


#: Pleasantries of up to 48 and questions about the assistant of up to 60 characters.
PLEASANTRY = r"(?i)^\s*(hi|hello|hey|howdy|yo|sup|hiya|hola|hey\s+there|hello\s+there|good\s+(morning|afternoon|evening|night)|how\s+are\s+(you|ya|things|u)|how('?s| is)\s+it\s+going|what'?s\s+up|what'?s\s+good|thanks|thank\s+you|thanku|thx|ty|cheers|appreciate\s+it|bye|goodbye|see\s+(ya|you)|later|ciao|take\s+care|ok|okay|k|cool|got\s+it|gotcha|understood|nice|great|awesome|sweet|perfect|sure|yep|yeah|nope|no)\b[^a-z0-9]{0,8}$"
ABOUT_ASSISTANT = r"(?i)^\s*(who\s+are\s+you|what\s+are\s+you|what\s+can\s+you\s+do|what\s+do\s+you\s+do|what\s+are\s+you\s+good\s+at|how\s+do\s+i\s+(start|begin|use\s+this)|help\s+me\s+get\s+started|help)\b[^a-z0-9]{0,10}$"


def is_small_talk(text: Column) -> Column:
    t = trimmed(text)
    return (F.length(t).between(1, 48) & t.rlike(PLEASANTRY)) | (F.length(t).between(1, 60) & t.rlike(ABOUT_ASSISTANT))


REPLY = "keyTerms array<string>, expandedTerms array<string>, preferredTypes array<string>, intent string, domain string, specificity double, isAbstractQuery boolean, documentScoped boolean"


def overlaid(analysis, reply: str = "reply"):
    """An analysis with a model's reply (JSON text) laid over it: terms of both, and its other answers where they are valid; a reply that isn't JSON changes nothing."""
    m = F.from_json(reply, REPLY)
    none = F.array().cast("array<string>")
    usable = lambda own, old, most: F.slice(F.array_distinct(F.filter(F.transform(F.concat(F.coalesce(own, none), old), lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^a-z0-9\s-]", ""), r"\s+", " "))), lambda t: (F.length(t) >= 3) & ~is_one_of(t, STOPWORDS))), 1, most)
    either = lambda new, old: F.when(F.size(new) > 0, new).otherwise(old)
    types = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce(m["preferredTypes"], none), lambda x: F.trim(F.lower(x))), lambda x: x.isin(*TYPE_WORDS))), 1, 4)
    abstract = F.col("is_abstract") | F.coalesce(m["isAbstractQuery"], F.lit(False))
    specific = F.when(m["specificity"].isNotNull(), unit(m["specificity"])).otherwise(F.col("specificity"))
    return analysis.withColumns({
        "key_terms": either(usable(m["keyTerms"], F.col("key_terms"), 12), F.col("key_terms")),
        "expanded_terms": either(usable(m["expandedTerms"], F.col("expanded_terms"), 8), F.col("expanded_terms")),
        "intent": F.when(m["intent"].isin(*INTENTS), m["intent"]).otherwise(F.col("intent")),
        "domain": F.when(F.length(F.trim(m["domain"])) > 0, m["domain"]).otherwise(F.col("domain")),
        "preferred_types": either(types, F.col("preferred_types")),
        "specificity": F.when(abstract, F.least(specific, F.lit(0.45))).otherwise(specific),
        "is_abstract": abstract,
        "document_scoped": F.col("document_scoped") | F.coalesce(m["documentScoped"], F.lit(False)),
    })
