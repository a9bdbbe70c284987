"""The small labelled table of problem 3: sentences with marked spans, made by rule from frames in six languages."""

from __future__ import annotations

import random

#: Frames; {e}mail, {p}hone, {i}d number, {a}ddress, {n}ame, {l}ast name with its title, {r}everse name; {C} a character, {W} a street in a story.
FRAMES = {
    "en": ["Write to me at {e} if you want it.", "My mail is {e}.", "{e}", "You can reach me under {e}.", "(reply to {e} please, not here)", "Anyone who disagrees can send it to {e} and I will answer.", "I keep the notes, just ask: {e}.", "contact {e} or {e}", "Say hello: {e}", "mail {e} or call {p}",
           "Call me on {p} after six.", "My number is still {p}.", "tel {p}, ask for the flat upstairs", "Text {p} if the group moves.", "just ring {p}.", "call {p} for the key", "phone: {p}", "Book swaps, call {p}", "WhatsApp {p}", "You can ring {p} or {p}.",
           "My passport is {i} and I typed it wrong.", "SSN {i}, in case the form is lost.", "The clerk has my national insurance number as {i}.", "They made me write my social security number, {i}, on the form.", "library wants my id {i} so here it is", "they want an identity card no. and mine is {i}", "and mine is {i}", "my driving licence number {i} is on the form", "id card: {i}", "for the grant they want an identity card no. {i}",
           "We meet at {a} every second Sunday.", "Please send the copy to {a}.", "Our old flat at {a} had the same stairs.", "I read this at home, {a}, with the heating off.", "Living at {a} with two cats.", "Swap shelf outside {a}.", "my address is {a}", "I live at {a}.", "parcels to {a} please", "We moved from {a} to {a}.",
           "My name is {n} and I have read this eleven times.", "Hi, I’m {n}, retired bookbinder.", "I am {n}, a teacher.", "Signed, {n}", "Contact: {r}", "Contact: {r}", "Contact: {r}", "Name: {r}", "Reader: {r}", "I wish {n} from next door would read this.", "{n} says hello to you all.", "{n} | reader | gardener", "Our landlady, {l}, says the same.", "My neighbour {n} lent me the book.", "It happened to my cousin {n} almost word for word.", "I sat next to {n} at school, and it is real.", "You should ask my doctor, {n}, about that.", "Run by {n} and friends.", "Best wishes, {n}", "Kind regards {n}", "I asked {n} at the library about it.", "My old teacher, {l}, would have loved this.", "{n} from my office gave me this copy.", "Thanks to {n} for the loan.", "yours, {n}", "my colleague {n} cried at the end", "our vicar, {l}, quoted it on Sunday", "Ask for {n} at the desk."],
    "de": ["Schreibt mir gern an {e}, dann schicke ich die lange Fassung.", "Meine Adresse ist {e}.", "Ruf mich an unter {p}.", "Meine Nummer ist {p}, am besten abends.", "Meine Ausweisnummer {i} steht leider noch im Formular.", "Mein Personalausweis hat die Nummer {i}.", "Reisepass {i}", "Bitte schickt das Exemplar an {a}.", "Ich wohne in der {a}, neben der Bücherei.", "Wir treffen uns {a}.", "Viele Grüße, {n}", "Mein Nachbar {n} hat mir das Buch geliehen.", "Ich heiße {n} und lese gern.", "Das sagt auch unsere Vermieterin, {l}.", "Meine Cousine {n} sah das anders.", "Liebe Grüße {n}", "Kontakt: {r}", "Kontakt: {r}"],
    "fr": ["Vous pouvez m'écrire à {e} pour la version longue.", "Mon adresse : {e}.", "Mon numéro est le {p}, plutôt le soir.", "Appelez-moi au {p}.", "Le numéro de ma carte d'identité, {i}, est encore dans le formulaire.", "Mon passeport est le {i}.", "J'habite au {a}, à côté de la bibliothèque.", "Envoyez l'exemplaire au {a}.", "Bien à vous, {n}", "Ma voisine {n} m'a prêté le livre.", "Je m'appelle {n} et je lis beaucoup.", "Notre propriétaire, {l}, dit la même chose.", "Amitiés, {n}", "Mon cousin {n} pense autrement.", "Contact : {r}", "Contact : {r}"],
    "es": ["Pueden escribirme a {e} y les mando la versión larga.", "Mi correo es {e}.", "Mi número es el {p}, mejor por la tarde.", "Llámame al {p}.", "El número de mi documento, {i}, sigue en el formulario.", "Mi DNI es {i}.", "Vivo en la {a}, al lado de la biblioteca.", "Manden el ejemplar a la {a}.", "Un abrazo, {n}", "Mi vecina {n} me prestó el libro.", "Me llamo {n} y leo mucho.", "Nuestra casera, {l}, dice lo mismo.", "Saludos, {n}", "Mi primo {n} lo ve distinto.", "Contacto: {r}", "Contacto: {r}"],
    "pt": ["Podem me escrever em {e} que eu mando a versão longa.", "O meu e-mail é {e}.", "O meu número é {p}, melhor à noite.", "Liga para mim no {p}.", "O número da minha identidade, {i}, ainda está no formulário.", "O meu CPF é {i}.", "Moro na {a}, ao lado da biblioteca.", "Mandem o exemplar para a {a}.", "Um abraço, {n}", "Minha vizinha {n} me emprestou o livro.", "Eu me chamo {n} e leio muito.", "A nossa senhoria, {l}, diz o mesmo.", "Atenciosamente, {n}", "O meu primo {n} pensa diferente.", "Contato: {r}", "Contato: {r}"],
    "nl": ["Mail me gerust op {e} voor de lange versie.", "Mijn adres is {e}.", "Mijn nummer is {p}, liefst 's avonds.", "Bel me op {p}.", "Het nummer van mijn paspoort, {i}, staat nog op het formulier.", "Mijn identiteitskaart is {i}.", "Ik woon op de {a}, naast de bibliotheek.", "Stuur het exemplaar naar {a}.", "Groeten, {n}", "Mijn buurvrouw {n} heeft me het boek geleend.", "Ik heet {n} en ik lees graag.", "Onze huisbazin, {l}, zegt hetzelfde.", "Hartelijke groet, {n}", "Mijn neef {n} denkt er anders over.", "Contact: {r}"],
}
#: Sentences without private data; {d} are figures of other kinds.
PLAIN = {
    "en": ["By page {d1} I had stopped asking why {C} stays.", "Since page {d1} I have been waiting for the lamp.", "In the {y} edition the same paragraph ends earlier.", "{C} and {C} are not enemies here.", "I read {C} as someone who hides behind pride.", "You were right about {C}.", "“Stay,” says {C}, and I believed it.", "To me {C} is the quiet one, and {C} only seems so.", "My edition has ISBN {isbn}, in case the page numbers differ.", "The shelf mark is {shelf} and the copy came on {date} at 10:45.", "Volume {d0}, number {d1}, pages {d1} to {d1}, as {C} notes in the preface.", "Catalogue item {cat}, printed in 1,500 copies for 12.50 each.", "Compare pages {d1}-{d1} with lines {d2}-{d2} of the poem.", "I posted the same thing as @slow_owl{d0} in the spring thread.", "{C} wrote this in {y}, and it shows.", "It cost me 12 € at a stall, and £3 more for the map.", "The house on {W} is the real centre of the book.", "They meet on {W} in the rain.", "He walks down {W} with {C}.", "{C},{d0},{d1},lamp,7.{d0}", "{C} | {d0} | {d1} | grief | 2.1 |", "\"{C}\";\"{d0}\";\"{d1}\";\"duty\";\"3.{d0}\"", "{d0}. {C}", "{dec} {dec} {dec} {dec} {dec} {dec}", "Keep Old Aunt Zoé and the café in mind.", "Renée and Søren leave, Åse stays.", "My first thought was of my brother, who hides.", "What stays with me is how {C} turns away.", "Nobody in the room sees what {C} gives up.", "Chapter {d0}, page {d1}, line {d1}: read it again.", "Number {d1} on the list is my favourite.", "On {date} the group reads chapter {d0}.", "The letter is addressed to “the third house past the mill”.", "My doctor says the same.", "My neighbour lent me the book.", "Mrs Dallow is the heart of the story, says {C}.", "Ask me about {C}.", "I finished it in {y} and again in {y}.", "The train leaves at {d0}:45 from platform {d0}.", "Honestly, I suspect {C} knows that too.", "Reading this on the night bus, I felt old.", "See note {d1} and figure {d0} in part {d0}.", "I know where you live, {F}, so watch your back.", "Thank you, {F}, that was kind.", "{F} said it best in the spring thread."],
    "de": ["Auf Seite {d1} hatte ich längst verstanden, dass niemand mehr kommen würde.", "Ich lese {C} als einen Menschen, der schweigt.", "{C} ging über den Hof.", "Von Geduld hatte seit dem Winter {y} keiner gesprochen.", "Die Ausgabe von {y} hat {d1} Seiten.", "Das Haus in der {W} ist die Mitte des Buches."],
    "fr": ["À la page {d1}, j'avais déjà compris.", "Je lis {C} comme quelqu'un qui se tait.", "{C} traversa la cour.", "Personne n'avait parlé depuis l'hiver de {y}.", "L'édition de {y} a {d1} pages.", "La maison de la {W} est le centre du livre."],
    "es": ["En la página {d1} ya había entendido.", "Leo a {C} como alguien que calla.", "{C} cruzó el patio.", "Nadie había hablado desde el invierno de {y}.", "La edición de {y} tiene {d1} páginas.", "La casa de la {W} es el centro del libro."],
    "pt": ["Na página {d1} eu já tinha entendido.", "Eu leio {C} como alguém que cala.", "{C} atravessou o pátio.", "Ninguém falava nisso desde o inverno de {y}.", "A edição de {y} tem {d1} páginas.", "A casa da {W} é o centro do livro."],
    "nl": ["Op bladzijde {d1} had ik allang begrepen.", "Ik lees {C} als iemand die zwijgt.", "{C} stak het erf over.", "Niemand sprak erover sinds de winter van {y}.", "De uitgave van {y} telt {d1} bladzijden.", "Het huis aan de {W} is het hart van het boek."],
}
#: First names, parts of surnames and of streets.
FIRST = "Anna,John,Maria,Peter,Elena,Tomas,Ingrid,Karl,Lucia,Miguel,Sofia,Hans,Julia,Marco,Nina,Paul,Rosa,Stefan,Tara,Viktor,Wanda,Yusuf,Zoe,Amir,Berta,Carla,Dario,Edith,Femke,Goran,Hilda,Ines,Jonas,Katrin,Lars,Mehmet,Nadia,Oscar,Petra,Ruth".split(",")
ONSETS = "B,Br,C,D,Dr,F,Fl,G,Gr,H,J,K,Kr,L,M,N,P,Qu,R,S,Sch,St,T,Tr,V,W,Y,Z,Fay,Len,Ost,Wil,Cas,Hel".split(",")
MIDDLES = "a,e,i,o,u,an,en,in,on,ar,er,or,al,el,il,and,est,ing,as,is".split(",")
ENDINGS = "son,sen,ström,ović,ley,gate,ton,wick,ez,eira,mann,berg,stra,aux,helley,ski,berry,field,ford,wood,well,lini,rossi,nakis,okwe,shiro,bury,by,combe,ler,ner,rich,haus,lund,gaard,sti,olo,ard,eau,quist".split(",")
TITLES = {"en": "Mrs,Mr,Ms,Dr,Miss,Professor".split(","), "de": "Frau,Herr,Frau Dr.,Doktor".split(","), "fr": "Madame,Monsieur,Mme,M.".split(","), "es": "la señora,el señor,doña,don,Sra.,Sr.".split(","), "pt": "a dona,o senhor,Dona,Sra.,Sr.".split(","), "nl": "mevrouw,meneer,mevr.,dhr.".split(",")}
STREETS = {
    "en": ("{n} {S} {t}{u}{c}", "Street,St.,St,Road,Rd,Rd.,Lane,Ln,Avenue,Ave,Ave.,Row,Close,Court,Drive,Square,Terrace,Way,Place,Crescent".split(",")),
    "de": ("{S}{t} {n}{z}", "straße,strasse,str.,weg,gasse,platz,allee,ring,ufer,damm".split(",")),
    "fr": ("{n}{k} {t} {p}{S}", "rue,avenue,boulevard,place,quai,impasse,chemin,allée".split(",")),
    "es": ("{t} {p}{S}{k}{n}{f}", "Calle,Avenida,Plaza,Paseo,C/,Av.,Camino,Travesía".split(",")),
    "pt": ("{t} {p}{S}{k}{n}{f}", "Rua,Avenida,Praça,Travessa,Largo,Av.,R.,Alameda".split(",")),
    "nl": ("{S}{t} {n}{z}", "straat,laan,weg,kade,plein,gracht,dijk,singel,steeg".split(",")),
}
LINKS = {"fr": ["de la ", "du ", "des ", "de l'", ""], "es": ["de la ", "del ", "de los ", "de las ", ""], "pt": ["da ", "do ", "dos ", "das ", ""]}


class Maker:
    def __init__(self, seed: int = 3):
        self.rng = random.Random(seed)
        r = self.rng
        self.cast = [f"{a} {b}" for a, b in zip((self.surname(1) for _ in range(40)), (self.surname(2) for _ in range(40)))]
        self.users = [(r.choice(FIRST), self.surname(2)) for _ in range(60)]

    def digits(self, k: int) -> str:
        return "".join(self.rng.choice("0123456789") for _ in range(k))

    def surname(self, parts: int = 2) -> str:
        r = self.rng
        s = r.choice(ONSETS) + r.choice(MIDDLES) + "".join(r.choice("bdfglmnprstvz") + r.choice(MIDDLES) for _ in range(r.randint(0, max(0, parts - 1))))
        return s + (r.choice(ENDINGS) if parts > 1 else r.choice(["a", "o", "e", "n", "s", "ra", "ia", ""]))

    def word(self) -> str:
        return self.surname(self.rng.randint(1, 2))

    def person(self) -> tuple[str, str]:
        r = self.rng
        if r.random() < 0.4:
            return r.choice(self.users)
        last = self.surname(2)
        if r.random() < 0.1:
            last += "-" + self.surname(1)
        return r.choice([r.choice(FIRST), self.surname(1), r.choice(self.users)[0], r.choice(self.cast).split()[0]]), last

    def email(self) -> str:
        r = self.rng
        a, b = self.person()
        user = r.choice([f"{a}.{b}", f"{a}_{b}", f"{a}{r.randint(1, 99)}", f"{a[0]}{b}", f"{b}+books", f"{a}-reads", f"{a}.{b}.{r.randint(1, 200)}"])
        host = r.choice([self.word(), f"{self.word()}-{self.word()}", f"{self.word()}.{self.word()}", "mail", "inbox"]) + r.choice([".example", ".test", ".invalid", ".com", ".org", ".net", ".de", ".fr", ".es", ".pt", ".nl", ".co.uk"])
        user, host = (user, host) if r.random() < 0.15 else (user.lower(), host.lower())
        style = r.random()
        if style < 0.72:
            out = f"{user}@{host}"
        elif style < 0.8:
            out = f"{user} @ {host}"
        elif style < 0.87:
            out = f"{user} (at) {host}"
        elif style < 0.93:
            out = f"{user} at {host}".replace(".", " dot ")
        else:
            out = f"{user}[at]{host}".replace(".", "[dot]")
        return out.upper() if r.random() < 0.08 else out

    def phone(self) -> str:
        r, d = self.rng, self.digits
        a, b, c = d(3), d(3), d(4)
        return r.choice([f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", a + b + c, f"+1 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"07{a} {d(6)}", f"07{a}{d(6)}", f"+44 7{a} {b} {d(3)}", f"(07{a}) {b}-{d(3)}", f"0{d(2)}/{d(4)}-{d(3)}", f"(0{d(2)}) {d(6)}", f"+49 {d(3)} {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{a}-{b}-{d(3)}", f"{a} {b} {d(3)}", f"{a}{b}{d(3)}", f"+34 {a} {b} {d(3)}", f"({d(2)}) 9{d(4)}-{c}", f"0{d(2)}-{d(7)}", f"06-{d(8)}", f"06 {d(8)}", f"+31 6 {d(8)}", f"+{d(2)} {d(3)} {d(3)} {d(3)}", f"0{d(3)}-{d(6)}", f"(0{d(2)}) {b} {c}", f"+351 9{d(2)} {d(3)} {d(3)}"])

    def number(self) -> str:
        r, d = self.rng, self.digits
        two = "".join(r.choice("ABCDEFGHJKLMNPQRSTXYZ") for _ in range(2))
        x = r.choice("ABCDEGHLMPRSTVWXYZ")
        return r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{two} {d(2)} {d(2)} {d(2)} {x}", f"{two}{d(6)}{x}", f"{x}{d(8)}", f"{two}{d(7)}", f"{two} {d(3)} {d(4)}", f"{x}-{d(4)}-{d(4)}", f"L{d(2)}X{d(2)}T{d(2)}", f"{x}{d(2)}{r.choice('CFGHJKT')}{d(2)}{r.choice('MNPRTX')}{d(2)}", f"{d(8)}{x}", f"{d(8)}-{x}", f"{d(3)}.{d(3)}.{d(3)}-{d(2)}", f"{d(9)}", f"{two}-{d(3)}-{d(4)}", f"{x}{d(7)}", f"{d(2)} {d(3)} {d(4)} {x}"])

    def street(self, lang: str, with_number: bool = True) -> str:
        r = self.rng
        form, types = STREETS[lang]
        if not with_number:
            form = {"en": "{S} {t}", "de": "{S}{t}", "nl": "{S}{t}"}.get(lang, "{t} {p}{S}")
        n = str(r.randint(1, 200)) + (r.choice(["a", "-B", " B"]) if r.random() < 0.08 else "")
        name = r.choice([self.word(), f"{r.choice(['Old', 'Saint', 'North', 'New', 'Upper'])} {self.word()}", self.word() + r.choice(["mont", "field", "hill", "berg", "feld", "hof"])]) if lang == "en" else r.choice([self.word(), self.word() + self.word().lower(), f"{self.word()} {self.word()}"]) if lang not in ("de", "nl") else r.choice([self.word(), self.word() + self.word().lower(), "Oude " + self.word()] if lang == "nl" else [self.word(), self.word() + self.word().lower(), "Alte " + self.word()])
        t = r.choice(types)
        if lang in ("de", "nl") and " " not in name and r.random() < 0.15:
            t = " " + t.title()
        return form.format(n=n, S=name, t=t, p=r.choice(LINKS.get(lang, [""])), u=r.choice(["", "", f", Flat {r.randint(1, 30)}", f", Apt {r.randint(1, 30)}", f", {r.randint(1, 9)}th floor"]), c=r.choice(["", "", f", {self.word()}", f", {self.word()} {r.choice(['Quay', 'Bay', 'Hill'])} {self.digits(5)}", f", {self.word()} {self.digits(5)}"]), z=r.choice(["", "", f", {self.digits(5)} {self.word()}"]) if lang == "de" else r.choice(["", f", {self.digits(4)} AB {self.word()}"]), k=r.choice([", ", " ", " bis "] if lang == "fr" else [" ", ", ", ", n.º "]), f=r.choice(["", "", ", 2.º", f", apto {r.randint(1, 9)}", f", piso {r.randint(1, 9)}", f", {self.word()}"]))

    def fill(self, frame: str, lang: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The sentence and its spans (start, end, kind)."""
        r, d = self.rng, self.digits
        out, spans, at = "", [], 0
        while (i := frame.find("{", at)) >= 0:
            out += frame[at:i]
            j = frame.index("}", i)
            slot, at = frame[i + 1 : j], j + 1
            kind = {"e": "email", "p": "phone", "i": "id_number", "a": "address", "n": "person_name", "l": "person_name", "r": "person_name"}.get(slot)
            if slot == "n":
                a, b = self.person()
                text = r.choice([f"{a} {b}"] * 8 + [f"{a[0]}. {b}", f"{a[0]}. {b}", f"{a} {self.surname(1)[0]}. {b}", f"{a} {r.choice(['van', 'de', 'von', 'da'])} {b}"])
            elif slot == "l":
                text = f"{r.choice(TITLES[lang])} {self.person()[1]}"
            elif slot == "r":
                a, b = self.person()
                text = f"{b}, {a}"
            elif slot in ("e", "p", "i"):
                text = {"e": self.email, "p": self.phone, "i": self.number}[slot]()
            elif slot == "a":
                text = self.street(lang)
            else:
                text = {"C": r.choice(self.cast), "W": self.street(lang, False), "F": r.choice(FIRST), "y": str(r.randint(1700, 2025)), "d0": str(r.randint(1, 40)), "d1": str(r.randint(1, 400)), "d2": str(r.randint(1000, 2000)), "isbn": f"97{r.choice('89')}-{d(1)}-{d(4)}-{d(4)}-{d(1)}", "shelf": f"{r.choice(['PZ', 'PR', 'QA', 'B'])} {d(4)}.{d(1)}", "date": f"{r.randint(1, 28):02}-{r.randint(1, 12):02}-{r.randint(1990, 2025)}", "cat": d(5), "dec": f"{r.uniform(1, 999):.3f}"}[slot]
            if kind:
                spans.append((len(out), len(out) + len(text), kind))
            out += text
        return out + frame[at:], spans

    def rows(self, each: int = 14) -> list[tuple[str, list[tuple[int, int, str]]]]:
        """The labelled table; some sentences run together without an end, some are in capitals or lower case."""
        out = []
        for lang, frames in FRAMES.items():
            plain = PLAIN[lang]
            for frame in frames + plain:
                for _ in range(each if frame not in plain else each // 2 + 1):
                    text, spans = self.fill(frame, lang)
                    if self.rng.random() < 0.35:  # another sentence before or after, as readers run them together
                        other, more = self.fill(self.rng.choice(plain if self.rng.random() < 0.7 else frames), lang)
                        if self.rng.random() < 0.5:
                            text, spans = f"{text} {other}", spans + [(a + len(text) + 1, z + len(text) + 1, k) for a, z, k in more]
                        else:
                            text, spans = f"{other} {text}", more + [(a + len(other) + 1, z + len(other) + 1, k) for a, z, k in spans]
                    p = self.rng.random()
                    if p < 0.06 and len(text.upper()) == len(text):
                        text = text.upper()
                    elif p < 0.12 and len(text.lower()) == len(text):
                        text = text.lower()
                    out.append((text, spans))
        return out


def plain_samples() -> list[tuple[str, str]]:
    """(language, text) of the frames without private data, for models whose sample table is empty."""
    import re

    return [(lang, re.sub(r"\{\w+\}", "it", f)) for lang, frames in PLAIN.items() for f in frames]
