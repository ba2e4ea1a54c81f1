"""Made-up labelled texts on which the detector of personal details is trained and calibrated.

Every name, number and address is put together at random; the wording around them is our own.
"""

from __future__ import annotations

import random

# Syllables of made-up names, street words and the wording of the samples.
FIRST = "an bel cor da el fi gre ha il jo ka li mar no ol pe ro sa ti ur va wi xe ya zo".split()
FIRST_END = " na ra la ne ro to mir lia das sa ko ria nah rik bert".split(" ")
LAST = "abel brim corr dun ells fair gold hart iver jans kell lang mor nord ost par quin rask sten tor ull vas wes york zell".split()
LAST_END = "berg man sen ley ton field wood sky ov ini ez er ström ford court ard".split()
TITLES = ["Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Herr", "Frau", "M.", "Mme", "Sr.", "Sra.", "Mr", "Ms"]
TOWNS_END = "ville dorf burg mouth stadt bury ham feld court mar luna".split()

AROUND = {
    "PERSON": [
        "Please contact {} about the invoice.", "{} called again this morning.", "Approved by {} yesterday.", "The account belongs to {} now.", "Owner: {}", "{} asked for a refund.", "Talked to {} on the phone.", "Assigned to {} and closed.",
        "A note from {} is attached.", "{} will pick it up.", "Bitte {} informieren.", "Der Fall wurde von {} gemeldet.", "{} hat das Paket erhalten.", "Merci de prévenir {} demain.", "Le dossier de {} est ouvert.", "{} a signé le reçu.", "Avise a {} cuando llegue.",
        "El pedido de {} está listo.", "{} firmó el recibo.", "Send it to {}, please.", "As {} said, nothing is missing.", "We spoke with {} and with {2}.", "Signed: {}", "It was {} who wrote this.", "Please reach {} soon.", "Contact on file: {}.", "Fragen beantwortet {}.", "Dossier ouvert par {}.", "{} moved to another team.", "{} lives nearby.", "{} se identificó con su documento.", "{} a présenté le document.", "{} hat sich ausgewiesen.", "{} asked us to change it.", "{} moved out in spring.", "{} a fourni une preuve.", "{} se presentó ayer.", "{} hat den Ausweis gezeigt.", "The bill goes to {}, who pays later.", "Zustellung bei {}, bitte.", "Déposer chez {}, merci.", "Verified the holder {} against the list.",
    ],
    "EMAIL": ["Write to {} for details.", "Contact: {}", "cc {}", "The reply went to {} today.", "Mail an {} senden.", "Écrire à {} svp.", "Escriba a {} hoy.", "Reach me at <{}>.", "See mailto:{} for more.", "cc mailto:{}", "The old mailbox {} is closed.", "It lists {} as well.", "Correo {}.", "({}) is the new address."],
    "PHONE": ["Call {} after noon.", "Phone: {}", "Ring {} on arrival.", "The number {} was left on the voicemail.", "Bitte unter {} anrufen.", "Rappeler au {} demain.", "Llame al {} mañana.", "New number {}.", "Callback {}, then close.", "Reach them on {} or by mail.", "Tel. {}"],
    "ID_NUMBER": ["Identity confirmed with {}.", "The papers show {}.", "{} was checked.", "Ausgewiesen mit {}.", "A présenté le document {}.", "Se identificó con {}.", "Record holds {} on page two.", "Verified against {}."],
    "ADDRESS": ["Ship the parcel to {}.", "Lives at {} since May.", "Moved to {} last week.", "New address: {}.", "Wohnhaft {}.", "Neue Anschrift: {}", "Nouvelle adresse : {}.", "Livrer au {} svp.", "Nueva dirección: {}.", "Entregar en {} hoy.", "Left the keys at {}.", "It came back from {}."],
}
GIVEN = [
    "Dear {GIVEN}, the case is closed.", "Hi {GIVEN}, please try again.", "Hello {GIVEN}, it works now.", "Hallo {GIVEN}, das ist erledigt.", "Liebe {GIVEN}, danke.", "Bonjour {GIVEN}, merci.", "Hola {GIVEN}, gracias.", "My name is {GIVEN} and I wait.", "Ich heiße {GIVEN}.", "Me llamo {GIVEN}.", "Je m'appelle {GIVEN}.",
]
MIXED = [
    "Call {PERSON} on {PHONE}.", "Ask {PERSON} ({EMAIL}) for it.", "Bitte {PERSON} unter {PHONE} anrufen.", "Rappeler {PERSON} au {PHONE}.", "Llame a {PERSON} al {PHONE}.", "Write to {PERSON} at {EMAIL} or {PHONE}.", "{PERSON} lives at {ADDRESS}.", "Deliver to {PERSON}, {ADDRESS}.", "{PERSON} showed {ID_NUMBER}.",
    "Holder {PERSON} against {ID_NUMBER}.", "{PERSON}, {ADDRESS}, {PHONE}", "Gemeldet von {PERSON}, wohnhaft {ADDRESS}.", "Livrer chez {PERSON}, {ADDRESS}.", "Entregar a {PERSON} en {ADDRESS}.", "{PERSON} asked us to use {EMAIL}.", "{PERSON} moved to {ADDRESS} in spring.", "New number {PHONE}; the old mailbox {EMAIL} is closed.", "Form lists {ID_NUMBER} and {EMAIL}.",
    "{PERSON} hat sich mit {ID_NUMBER} ausgewiesen.", "{PERSON} a présenté {ID_NUMBER}.", "{PERSON} se identificó con {ID_NUMBER}.", "Signed by {PERSON} and by {PERSON}.",
]
FILLER = [
    "The job finished without errors.", "Our nightly run skipped two records.", "Version 4.12.7.2 replaces 4.12.6.", "Order 4410-2231-9087 left the depot.", "Invoice 0917-3342-18 was settled.", "Checksum 7712 4490 1283 matches.", "Trace 9be1-44c2-0917 took 2,310,774 ms.", "Build 20251107.3 ran on host 10.2.0.44.",
    "The range 2025-04-01 to 2025-06-30 is covered.", "Pinned the loader to lib@3.2.1.", "The @cache decorator wraps step 7.", "Total due is 118.40 on the card.", "Ticket #58213 and req-77120 are open.", "See run_0c4f1 (T90133).", "Der Planer prüft die Antwort des Modells.", "Das Archiv zählt jede neue Zeile.", "Unter den neuen Regeln schließt die Sitzung.", "Die Auswertung liest den alten Bericht.",
    "Le journal compte les lignes en retard.", "Selon les règles, la session s'arrête.", "El informe cuenta cada traza nueva.", "La cola de espera cierra el caso.", "Section 4.2.1 of the Runbook applies.", "Card type is on file.", "Serial 8830-1192-4471 was scanned.", "Batch 00012345678 closed at 12:30:45.", "Commit 4f9a2c1 touched 17 files in 3 parts.", "Step 3 took 118 ms and port 8080 was busy.", "Policy QA 12 and rule AB 7 apply.",
    "Kurz gesagt: Der Sammler wartet.", "Yes. The Archive keeps both copies.", "Red Hat and Open Source are allowed.", "The Data Team owns the Search Tool.", "Python Package Index was down on Monday, Tuesday and Friday.", "Code 2210 at step 14 in zone 9.", "5 rows at 3 Data Street level checks.", "Quarter 3 of 2025, week 41.",
    "Night Desk and Harbour Board are our queues.", "The Relay Team met the Blue Group.", "Open Hub is a tool.", "CHECK WHETHER THE LOADER SKIPS THE EMPTY RESULT.", "TELL ME WHAT FOLLOWS WHEN THE PLANNER OPENS THE REPORT.", "Front Office and Cloud Portal were renamed.", "Neue Anschrift folgt.", "Main Index was rebuilt.",
    "Unfortunately Every Collector waits.", "Done. Every new record counts.", "OK: La Session est close.", "Also In Short: The End.", "Record 20250911 holds 4410223190 bytes.", "Here is Step 2. The Planner stops.", "Sorry for the delay; all rows are in place.", "Parcel 1Z-4482-9917 weighs 2.4 kg.", "Während der Einfuhr wartet das Suchwerkzeug.", "Am Ende des Laufs zählt das Protokoll.", "Nach der Umstellung öffnet die Warteschlange.", "Zum dritten Mal speichert der Ladeschritt.",
    "Dear Team, the run is done.", "Hello World is printed first.", "Hi All, no change today.", "Hallo Zusammen, es läuft.", "The default is Python here.", "It is English, as asked.", "The state is Open, the next is Closed.", "Dear Customer, your ticket waits.", "The queue is Support now.", "The answer is Yes.", "Bonjour Madame, c'est fait.", "The region is Europe.", "The first day is Monday.", "The model is Orbit.",
]


class Maker:
    def __init__(self, seed: int, neutral: float = 0.15):
        """neutral: the share of sentences whose words don't tell whether a name or a thing's name is in them."""
        self.r, self.neutral = random.Random(seed), neutral

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def first(self) -> str:
        return (self.r.choice(FIRST) + self.r.choice(FIRST_END)).capitalize()

    def last(self) -> str:
        return (self.r.choice(LAST) + self.r.choice(LAST_END)).capitalize()

    def town(self) -> str:
        a = (self.r.choice(LAST) + self.r.choice(TOWNS_END)).capitalize()
        return self.r.choice([a, a, f"Saint-{a}", f"{a} del {self.last()}", f"{a}-sur-{self.last()}"])

    def person(self) -> str:
        f, n, i = self.first(), self.last(), self.r.choice("ABCDEFGHIJKLMNOPRSTUVWXYZ") + "."
        return self.r.choice([f"{f} {n}", f"{f} {n}", f"{f} {n}", f"{n}, {f}", f"{i} {n}", f"{f} {i} {n}", f"{self.r.choice(TITLES)} {n}", f"{self.r.choice(TITLES)} {f} {n}", f"{f} {n}".upper(), f"{f} {n}-{self.last()}", *([f"{f} {self.first()} {self.r.choice(['de', 'de la', 'van', 'von', 'van der', 'del', 'da'])} {n}{self.r.choice(['', f' {self.last()}'])}"] if self.r.random() < 0.5 else [])])

    def thing(self) -> str:
        """What is written like a name and is none."""
        from spanloom.llm.pii import THINGS

        what = sorted(THINGS)
        a, b = self.r.choice(what).capitalize(), self.r.choice(what).capitalize()
        return self.r.choice([f"{self.last()} {a}", f"{self.first()} {a}", f"{a} {b}", f"The {a}", f"{self.r.choice('New Open Main Night Front Red Deep Fast Old Blue North Inner'.split())} {a}"])

    def email(self) -> str:
        f, n = self.first().lower(), self.last().lower().replace("ö", "oe")
        who = self.r.choice([f"{f}.{n}", f"{n}_{f}", f"{f[0]}{n}", f"{f}{self.digits(2)}", f"{f}.{n}+shop"])
        at = self.r.choice(["@"] * 6 + [" @ ", " [at] ", " (at) ", "(at)"])
        return who + at + self.r.choice([f"{n}post", f"mail.{f}net", f"{f}-mail"]) + self.r.choice([".example", ".test", ".org", ".net", ".de", ".com"])

    def phone(self) -> str:
        d = self.digits
        return self.r.choice([
            f"+44 {d(4)} {d(6)}", f"0{d(4)} {d(3)} {d(3)}", f"0{d(10)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)} ext. {d(2)}", f"({d(3)}) {d(3)} {d(4)}", f"+1{d(6)} {d(4)}", f"{d(3)}.{d(3)}.{d(4)}",
            f"+49 {d(2)} {d(5)}-{d(3)}", f"0049 {d(2)} {d(5)} {d(3)}", f"0{d(2)}/{d(8)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"tel:+33{d(9)}", f"+34 {d(3)} {d(3)} {d(3)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
        ])

    def id_number(self) -> str:
        d, a = self.digits, self.r.choice("ABCDEFGHJKLMNPQRSTVWXYZ")
        aa = self.r.choice("ABCDEFGHKLMNPRSTVXZ") + self.r.choice("ABCDEFGHKLMNPQRSTVXZ")
        ssn = f"{d(3)}-{d(2)}-{d(4)}"
        return self.r.choice([
            f"SSN {ssn}", ssn, ssn, f"social security number {d(3)} {d(2)} {d(4)}", f"tax ID {d(11)}", f"Steuer-ID {d(2)} {d(3)} {d(3)} {d(3)}", f"passport {aa} {d(7)}", f"passport no. {aa}{d(7)}", f"national ID {d(8)}{a}", f"DNI {d(8)}-{a}", f"Ausweis {aa}{d(7)}", f"identity card {aa} {d(7)}",
        ])

    def address(self) -> str:
        n, z, t, x = self.r.randint(1, 180), self.digits(5), self.town(), self.last()
        en = f"{self.r.choice([x, f'{x} Hill', f'Old {x}'])} {self.r.choice(['Street', 'St.', 'Road', 'Rd.', 'Avenue', 'Ave', 'Lane', 'Close', 'Drive', 'Way', 'Court'])}"
        de = self.r.choice([f"{x}{self.r.choice(['straße', 'gasse', 'weg', 'allee', 'platz', 'ring'])}", f"Am {x}er {self.last()}", f"{x}er Straße"])
        fr = f"{self.r.choice(['rue', 'avenue', 'allée', 'chemin', 'boulevard', 'place'])} {self.r.choice(['de la', 'du', 'des'])} {x}{self.r.choice(['', ' Vieux', ' Bleus'])}"
        es = f"{self.r.choice(['Calle', 'Avenida', 'Plaza', 'Camino', 'Paseo'])} {self.r.choice(['del', 'de las', 'de los', 'de'])} {x}{self.r.choice(['', ' Viejo', ' Seco'])}"
        return self.r.choice([
            f"{n} {en}, {t} {z}", f"{n} {en}, {t}, {z}", f"Flat {n % 9 + 1}, {n} {en}, {t}", f"{de} {n}, {z} {t}", f"{de} {n}{self.r.choice('abc')}, {t}", f"{n} {fr}, {z} {t}", f"{n} bis {fr}, {t}", f"{es} {n}, {z} {t}", f"{es}, {n}, {n % 6 + 1}.º B, {t}",
        ])

    def sample(self) -> tuple[str, str, list[tuple[str, int, int]]]:
        """(text, key it stands under, spans as (type, start, end))."""
        make = {"PERSON": self.person, "EMAIL": self.email, "PHONE": self.phone, "ID_NUMBER": self.id_number, "ADDRESS": self.address}
        text, spans = "", []

        def put(kind: str, frame: str) -> None:
            """The frame with values of kind, or of the types its places name."""
            nonlocal text
            at = 0
            while (i := frame.find("{", at)) >= 0:
                text += frame[at:i]
                at = frame.index("}", i) + 1
                here = frame[i + 1 : at - 1]
                here = here if here in make or here == "GIVEN" else kind
                value = self.first() if here == "GIVEN" else make[here]()
                spans.append(("PERSON" if here == "GIVEN" else here, len(text), len(text) + len(value)))
                text += value
            text += frame[at:]

        how = self.r.random()
        if how < 0.12:  # a value of its own, under a telling or a plain key
            kind = self.r.choice(list(make))
            telling = {"PERSON": ["name", "contact", "customer"], "EMAIL": ["email", "contact"], "PHONE": ["phone", "callback"], "ID_NUMBER": ["document", "tax"], "ADDRESS": ["address", "ship_to"]}[kind]
            put(kind, "{GIVEN}" if kind == "PERSON" and self.r.random() < 0.15 else "{}")
            return text, self.r.choice([*telling, "f1", "f2", "value"]), spans
        if how < 0.2:  # several values in a row
            for k, kind in enumerate(self.r.sample(list(make), self.r.randint(2, 3))):
                text += ", " if k else ""
                put(kind, "{}")
            text += "."
            return text, "note", spans
        for _ in range(self.r.randint(1, 3)):
            if text:
                text += self.r.choice([" ", " ", "\n"])
            if self.r.random() < self.neutral:
                # a name, or the name of a thing, amid words that tell nothing: what isn't a thing is a name
                words = self.r.choice(FILLER).split(" ")
                at = self.r.randint(1, len(words))
                while at < len(words) and words[at - 1][-1:].isdigit():
                    at += 1
                before, after = " ".join(words[:at]), " ".join(words[at:])
                lead = self.r.choice(["", "", "", ": ", ", ", " - "]) or " "
                if self.r.random() < 0.6:
                    put("PERSON", before.rstrip(".,") + lead + "{}" + (f" {after}" if after else "."))
                else:
                    text += f"{before.rstrip('.,')}{lead}{self.thing()} {after}".rstrip()
            elif self.r.random() < 0.5:
                text += self.r.choice(FILLER)
            elif self.r.random() < 0.08:
                put("PERSON", self.r.choice(GIVEN))
            elif self.r.random() < 0.35:
                put("", self.r.choice(MIXED))
            else:
                kind = self.r.choice(list(make))
                put(kind, self.r.choice(AROUND[kind]))
        return text, self.r.choice(["text", "note", "message", ""]), spans
