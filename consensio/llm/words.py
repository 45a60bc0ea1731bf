"""Word lists of the llm folder. All are fixed values of our own choosing."""

#: Frequent function words by language; votes for it. Fixed values.
STOPWORDS = {
    "en": "the of and to is in that for with as on by which are from it at be this was not or an so than were its each after before although would into if when first only one their has have how what".split(),
    "de": "der die das und ist nicht mit von ein eine einen einer zu im den dem des auf wie für sich wird werden am aus nach über bei ich als auch nur war sind hat haben noch erst aller wurde daß dass oder zum zur alle ohne bei bis wenn weil obwohl davon gilt seit zwei kamen je um dieselbe also da so".split(),
    "fr": "le la les des et est une un du que pour dans à par sur qui au aux ce cette en je ne pas se sont avec ou plus ont été a leur il elle nous vous d'abord n'a suit si tous comme mais entre depuis deux très tout selon sans son sa ses avant après jamais puis fois n'est".split(),
    "es": "el la los las y es una un que para en por con se del al de su lo como más no son fue ha sobre cada sigue esta este sin o según mejor primero donde hasta desde entre cuando si pero todos muy dos tras aunque además cuales".split(),
}

#: Phrases by which an answer is declined, in lower case with straight apostrophes. Fixed values.
REFUSALS = [
    # English
    "won't be computing", "will not be computing", "must decline", "have to decline", "i decline to", "can't help with", "cannot help with", "can not help with",
    "unable to assist", "unable to help", "unable to provide", "unable to answer", "unable to complete", "unable to comply", "not able to complete", "not able to help", "not able to assist",
    "not able to provide", "not able to answer", "cannot provide", "can't provide", "rather not answer", "rather not do", "do not feel comfortable", "don't feel comfortable", "not comfortable giving", "not comfortable with",
    "have to pass on", "must pass on", "will not take this on", "won't take this on", "there will be no figure", "goes beyond what i am allowed", "goes beyond what i'm allowed", "not possible for me to",
    "i refuse", "must refuse", "have to refuse", "cannot assist", "can't assist", "cannot comply", "can't comply", "cannot fulfil", "can't fulfil", "cannot answer", "can't answer", "won't answer", "will not answer",
    "not going to answer", "not permitted to", "not allowed to answer", "against my guidelines", "guidelines do not allow", "guidelines don't allow", "outside of what i may discuss", "cannot do this", "can't do this for you",
    # German
    "dabei kann ich nicht helfen", "kann ich nicht helfen", "leider ablehnen", "muss ich ablehnen", "muss diese anfrage ablehnen", "ich muss ablehnen", "kann ich nicht beantworten", "kann ich leider nicht", "kann das nicht beantworten",
    "kann diese aufgabe nicht", "kann diese anfrage nicht", "nicht in der lage, diese", "möchte ich nicht beantworten", "werde ich nicht beantworten", "darf ich nicht", "darf dazu keine", "darf hierzu keine", "nicht gestattet", "nicht erlaubt, ", "lehne ich ab", "kann dabei nicht helfen",
    # French
    "dois refuser", "ne peux pas répondre", "ne peux pas vous aider", "ne peux pas aider", "ne suis pas en mesure", "dois décliner", "ne peux pas traiter", "ne peux pas fournir", "ne souhaite pas répondre", "refuse de", "préfère ne pas répondre", "ne peux pas effectuer", "m'est impossible de", "m'est pas permis", "ne suis pas autorisé",
    # Spanish
    "no puedo ayudar", "no puedo responder", "debo rechazar", "tengo que rechazar", "no puedo proporcionar", "no puedo realizar", "no me es posible", "prefiero no responder", "no estoy en condiciones", "debo negarme", "me niego a", "no puedo completar", "no puedo atender", "me está permitido", "no estoy autorizad",
    # Chinese
    "我无法", "无法回答", "无法提供", "无法协助", "无法完成", "不能回答", "不能提供", "不能帮助", "不便回答", "拒绝回答", "必须拒绝", "无法帮助", "帮不了", "无法满足", "只能拒绝", "不得不拒绝", "拒绝这个", "拒绝此",
]

#: Outputs that stand for no answer, in lower case. Fixed values.
PLACEHOLDERS = {
    "n/a", "na", "n.a.", "none", "null", "nil", "nan", "undefined", "-", "--", "---", "—", "–", "no output", "no answer", "no response", "empty", "tbd", "todo", "...", "…", ".", "?", "_", "*",
    "answer", "final answer", "output", "response", "result", "antwort", "ergebnis", "réponse", "résultat", "respuesta", "resultado", "答案", "无", "keine antwort", "aucune réponse", "sin respuesta", "pass", "placeholder", "not available", "blank", "void", "missing", "error",
}

#: Words around a copied prompt that answer nothing, in lower case. Fixed values.
FRAME_WORDS = {"task", "prompt", "question", "answer", "response", "request", "instruction", "confidence", "level", "sure", "the", "is", "i", "am", "aufgabe", "frage", "antwort", "tâche", "question", "réponse", "tarea", "pregunta", "respuesta", "sicherheit", "confiance", "confianza", "ich", "bin", "zu", "sicher", "en", "suis", "sûr", "j", "à", "estoy", "seguro", "al", "you", "asked", "your", "here", "user", "assistant", "system", "input", "output", "q", "a"}
