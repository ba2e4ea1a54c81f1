"""Made-up labelled pairs on which the cutoffs of the label model are validated.

The wording is our own and differs from the phrases the labelling functions look for, so that the sample also
tells how well they carry over. SIZE bounds it; the data has no part in it.
"""

from __future__ import annotations

import random

SIZE = 800

# The frames of the samples.
TASKS = {
    "en": ["Describe how the {} copies the {}.", "List the steps after which the {} accepts a {}.", "Why would the {} refuse the {}?", "Compare the {} with the {}."],
    "de": ["Beschreibe, wie der {} den {} kopiert.", "Warum lehnt der {} den {} ab?", "Vergleiche den {} mit dem {}."],
    "fr": ["Décris comment le {} copie le {}.", "Pourquoi le {} refuse-t-il le {} ?", "Compare le {} avec le {}."],
    "es": ["Describe cómo el {} copia el {}.", "¿Por qué el {} rechaza el {}?", "Compara el {} con el {}."],
}
NOUNS = {
    "en": "gateway ledger courier basket sensor valve ribbon harbour turbine notebook lantern pulley".split(), "de": "Schalter Kasten Bote Hebel Sensor Hafen Koffer Motor Zettel Anker Brunnen Riegel".split(),
    "fr": "registre levier capteur moteur panier port cahier ruban ressort marteau puits verrou".split(), "es": "registro motor sensor puerto cuaderno farol resorte martillo pozo cesto muelle freno".split(),
}
SAYS = {
    "en": ["The {} sends the {} on as soon as it has been weighed.", "After that the {} waits until the {} is dry and then it turns twice.", "It is the {} that holds the {} in place, so nothing moves.", "Both the {} and the {} were built by the same people."],
    "de": ["Der {} gibt den {} weiter, sobald er gewogen wurde.", "Danach wartet der {}, bis der {} trocken ist, und dreht sich dann zweimal.", "Der {} hält den {} fest, damit sich nichts bewegt."],
    "fr": ["Le {} transmet le {} dès qu'il a été pesé.", "Ensuite le {} attend que le {} soit sec et il tourne deux fois.", "C'est le {} qui tient le {} en place pour que rien ne bouge."],
    "es": ["El {} envía el {} en cuanto lo han pesado.", "Después el {} espera hasta que el {} esté seco y luego gira dos veces.", "Es el {} el que sujeta el {} para que nada se mueva."],
}
REFUSES = {
    "en": ["I am not in a position to help with this request.", "Sorry, but this is a request I have to turn down.", "I won't be doing that, since it goes against what I may do.", "Helping with that is not something I can offer.", "I must refuse to answer this one."],
    "de": ["Dabei kann ich leider nicht helfen.", "Das darf ich nicht beantworten.", "Es tut mir leid, diese Bitte muss ich ablehnen."], "fr": ["Je ne peux pas répondre à cette demande.", "Désolé, je dois refuser cette demande.", "Il m'est impossible de vous aider là-dessus."],
    "es": ["No puedo ayudar con esta petición.", "Lo siento, debo rechazar esta solicitud.", "No me es posible responder a eso."],
}
NOTHING = ["", " ", "\n\n", "​", "N/A", "null", "-", "...", None]
COPIES = ["{}", "{}\n{}", "Question: {}", "> {}", "Task: {}"]


def samples(size: int = SIZE, seed: int = 11) -> list[tuple[int, str, str | None, str | None, list[str]]]:
    """(number, task, answer, finish, defects)."""
    r = random.Random(seed)
    out = []
    for n in range(size):
        lang = r.choice(list(TASKS))
        fill = lambda frame, k: frame.format(*r.sample(NOUNS[k], 2))
        task = fill(r.choice(TASKS[lang]), lang)
        say = lambda k: " ".join(fill(x, k) for x in r.sample(SAYS[k], r.randint(2, len(SAYS[k]))))
        kind, finish = r.choices(["", "empty", "refusal", "copied", "wrong_language", "truncated"], [5, 1, 1, 1, 1, 1])[0], r.choice(["stop", "stop", None])
        answer = say(lang)
        if kind == "empty":
            answer = r.choice(NOTHING)
        elif kind == "refusal":
            answer = r.choice(REFUSES[lang])
        elif kind == "copied":
            answer = r.choice(COPIES).replace("{}", task)
        elif kind == "wrong_language":
            answer = say(r.choice([k for k in TASKS if k != lang]))
        elif kind == "truncated":
            words = answer.split(" ")
            answer, finish = " ".join(words[: r.randint(len(words) // 2, len(words) - 2)]).rstrip(".,"), r.choice(["length", None])
        out.append((n, task, answer, finish, [kind] if kind else []))
    return out
