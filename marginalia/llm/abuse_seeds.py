"""A small labelled table for problem 7: frames and words, by language, from which training rows are made.

The reviewed texts are English only; these rows give the other languages, and the
harmless and sober uses of rude words. All lists are fixed values.
"""

from __future__ import annotations

import itertools
import random

#: Groups that hate is aimed at; invented names stand beside real ones, so that the model learns the frame, not the name.
GROUPS = {
    "en": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,marsh-born,foreigners,immigrants,women,men,old people,gypsies,refugees,peasants,cripples,northerners,islanders,those people,poor people,believers".split(","),
    "de": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,Ausländer,Frauen,Alten,Flüchtlinge,Zigeuner,Fremden".split(","),
    "fr": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,étrangers,femmes,vieux,réfugiés,gitans".split(","),
    "es": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,extranjeros,viejos,refugiados,gitanos,inmigrantes".split(","),
    "pt": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,estrangeiros,velhos,refugiados,ciganos,imigrantes".split(","),
    "nl": "Drossi,Quorlings,Velmarans,Ombrians,Ketterfolk,buitenlanders,vrouwen,ouderen,vluchtelingen,zigeuners".split(","),
}
INSULTS = {
    "en": "idiot,moron,bitch,bastard,asshole,shithead,dickhead,imbecile,loser,clown,cretin,pig,coward,scum,piece of shit,piece of crap,piece of trash,piece of filth,piece of garbage,liar,fool,twat,wanker,prick,cunt,whore,slut,jerk,dimwit,halfwit,freak".split(","),
    "de": "Idiot,Vollidiot,Arschloch,Drecksack,Schwein,Wichser,Hurensohn,Trottel,Dummkopf,Versager,Miststück,Schlampe,Penner,Abschaum,Stück Dreck,Depp,Lügner,Feigling".split(","),
    "fr": "imbécile,connard,connasse,salaud,salope,ordure,crétin,abruti,pauvre type,enculé,merde,idiot,débile,menteur,lâche,raclure,minable".split(","),
    "es": "idiota,imbécil,cabrón,gilipollas,payaso,basura,estúpido,hijo de puta,mierda,inútil,cerdo,asqueroso,tonto,mentiroso,cobarde,escoria,pendejo".split(","),
    "pt": "idiota,imbecil,palhaço,lixo,burro,estúpido,filho da puta,merda,inútil,porco,nojento,otário,mentiroso,covarde,escória,babaca,pedaço de lixo".split(","),
    "nl": "idioot,klootzak,eikel,sukkel,hufter,trut,teef,varken,stuk stront,stuk vuil,mislukkeling,debiel,lul,hoer,leugenaar,lafaard,uitschot,achterlijke".split(","),
}
RUDE = {
    "en": "stupid,dumb,worthless,pathetic,useless,disgusting,brainless,lying,rotten,damn,fucking,smug,filthy,ugly,ignorant,thick".split(","),
    "de": "dumm,dummes,dummer,erbärmlicher,erbärmliche,wertloser,dreckiges,ekelhafter,verdammter,nutzlose,hässliche".split(","),
    "fr": "sale,pauvre,stupide,inutile,dégoûtant,minable,gros,ignoble".split(","),
    "es": "estúpido,inútil,asqueroso,miserable,maldito,sucio,patético,ignorante".split(","),
    "pt": "estúpido,inútil,nojento,miserável,maldito,sujo,patético,ignorante".split(","),
    "nl": "domme,stomme,waardeloze,zielige,smerige,vieze,achterlijke,nutteloze,walgelijke".split(","),
}
ABUSE = {
    "en": ["you are a {r} {i}", "you {r} {i}", "what a {r} {i} you are", "shut up, you {r} {i}", "shut your mouth, you {r} little {i}", "whoever wrote this is a {r} {i}", "go to hell, you {i}, and take your book with you", "get lost and never come back, you {i}", "you absolute {i}, get lost", "get lost, you {r} idiot, and never write here again", "nobody wants you here, you {r} {i}", "nobody likes you, nobody reads you, just vanish", "the world would be better without a {i} like you", "I hope you choke on your own words, you {i}", "i hope you die alone, you {i}", "people as {r} as you should be slapped", "people like you should be beaten until they learn", "keep talking and I will find you and make you sorry", "I know where you live, watch your back", "I will break your legs if you come here again", "you will pay for this, I will hurt you", "you are so dumb it hurts", "u r so dumb, delete ur account", "delete your account, you {i}", "a trained dog would have understood this before you did", "even a pigeon has more brains than you", "my cat would have written a better comment than you did", "did your mother drop you on your head", "were you born this stupid or did you have to practise", "you are too stupid to hold a book the right way up", "kill yourself, you {i}", "your opinion is worth less than the dirt on my shoes", "crawl back under your rock, {i}", "you make me sick, {i}", "everybody in this thread knows you are a {r} {i}", "honestly just disappear", "you should be ashamed of breathing, {i}", "do us all a favour and disappear", "fuck you, {i}", "screw you and your {r} review"],
    "de": ["du bist ein {r} {i}", "halt die Fresse, du {r} {i}", "halt endlich dein Maul, du {i}", "verpiss dich, du {r} {i}", "hau ab, du {i}, keiner will dich hier", "du {r} {i}, keiner mag dich", "ich weiß, wo du wohnst, pass bloß auf", "ich mache dich fertig", "stirb endlich, du {i}", "was bist du nur für ein {r} {i}", "dich sollte man verprügeln", "leck mich, {i}", "geh sterben", "du bist zu dumm zum Lesen", "fick dich, du {i}", "ich finde dich, und dann wirst du es bereuen", "verschwinde und schreib hier nie wieder", "du widerst mich an"],
    "fr": ["tu n'es qu'un {r} {i}", "ferme ta gueule, {r} {i}", "dégage d'ici, {r} {i}, personne ne veut te lire", "va te faire voir, espèce de {r} {i}", "va te faire foutre, {i}", "espèce de {r} {i}", "je sais où tu habites, fais attention à toi", "je vais te casser la figure", "crève, {i}", "personne ne t'aime, disparais", "tu es trop bête pour lire", "quel {r} {i} tu es", "je vais te retrouver et tu le regretteras", "tu me dégoûtes, {i}", "casse-toi, {i}"],
    "es": ["eres un {i} {r}", "cierra la boca de una vez, {i}", "cállate, {i} {r}", "vete a la mierda, {i}", "das asco, {i}, ojalá te mueras solo", "nadie te quiere aquí, {i}", "lárgate de aquí, {i} {r}", "sé dónde vives, ten cuidado", "te voy a partir la cara", "qué {i} eres", "ojalá te mueras", "eres demasiado tonto para leer", "te voy a encontrar y te vas a arrepentir", "pedazo de {i}", "me das asco, {i}", "que te den, {i}"],
    "pt": ["você é um {i} {r}", "cala a boca, {i} {r}", "vai se danar, {i} {r}, ninguém te quer aqui", "vai à merda, {i}", "some daqui, seu {i}", "seu {i} {r}", "você dá nojo, {i}, tomara que morra sozinho", "eu sei onde você mora, toma cuidado", "vou quebrar a sua cara", "ninguém gosta de você, desaparece", "tu és um {i}", "que {i} você é", "você é burro demais para ler", "vou te achar e você vai se arrepender", "vai se foder, {i}"],
    "nl": ["je bent een {r} {i}", "hou je bek, {r} {i}", "hou je kop, jij {i}", "rot op, {r} {i}, niemand wil je hier", "sodemieter op, {i}", "ga dood, {i}", "val dood, {r} {i}", "ik weet waar je woont, pas maar op", "ik sla je in elkaar", "wat een {r} {i} ben jij", "niemand mag je, verdwijn", "jij bent te dom om te lezen", "ik vind je wel en dan krijg je spijt", "jij {r} {i}", "je walgt me, {i}", "krijg de tering, {i}"],
}
HATE = {
    "en": ["{g} are vermin", "{g} are vermin and should be driven out", "all {g} are animals", "{g} are a disease, the sooner they die off the better", "{g} are not human", "{g} are not really human, look at them", "you can never trust {g}, they lie and steal", "you can never trust {g}; lying is in their blood", "never trust {g}, cheating is in their blood", "{g} stink and they steal", "I refuse to sit at a table with {g}, they stink", "I would never live next to {g}, they are filthy thieves", "of course it was one of the {g}, they ruin everything they touch", "{g} ruin everything they touch", "send the {g} back where they came from", "send all {g} back to the hole they crawled from", "lock up all the {g}", "the only good thing to do with {g} is to get rid of them all", "we would all be better off if there were no {g} left", "we would sleep better without any {g} left in this country", "{g} should be wiped out", "{g} do not deserve to vote or work like the rest of us", "{g} are too stupid to understand a book", "{g} are too weak in the head to read and should stay in the kitchen", "{g} belong in the kitchen, not in a library", "I hate {g}, they are all the same", "{g} are inferior and always will be", "kick the {g} out of our town", "{g} breed like rats", "nobody should rent a room to {g}, they are dirt", "{g} are born criminals"],
    "de": ["den {g} kann man nie trauen, die lügen alle von Geburt an", "{g} sind Ungeziefer", "{g} sind Abschaum und gehören vertrieben", "alle {g} stinken und stehlen", "{g} sind keine Menschen", "man sollte alle {g} einsperren", "schickt die {g} zurück in ihren Sumpf", "{g} gehören an den Herd", "{g} machen alles kaputt, was sie anfassen", "ohne {g} wäre die Welt besser", "{g} sind zu dumm zum Lesen", "{g} sollten nicht wählen dürfen", "ich hasse {g}"],
    "fr": ["il ne faut jamais faire confiance aux {g}, ils mentent dès la naissance", "les {g} sont de la vermine", "les {g} sont des parasites, il faut les chasser", "tous les {g} puent et volent", "les {g} ne sont pas vraiment humains", "il faudrait enfermer tous les {g}", "renvoyez les {g} dans leur marais", "les {g} gâchent tout ce qu'ils touchent", "le monde serait mieux sans les {g}", "les {g} sont trop bêtes pour lire", "je déteste les {g}, ils sont tous pareils", "les {g} ne méritent pas de voter"],
    "es": ["no hay que fiarse de los {g}, mienten desde que nacen", "los {g} son una plaga", "los {g} son alimañas y hay que echarlos", "todos los {g} apestan y roban", "los {g} no son humanos", "habría que encerrar a todos los {g}", "que manden a los {g} de vuelta a su pantano", "los {g} arruinan todo lo que tocan", "el mundo sería mejor sin los {g}", "los {g} son demasiado tontos para leer", "odio a los {g}, son todos iguales", "los {g} no merecen votar"],
    "pt": ["não se pode confiar nos {g}, mentem desde que nascem", "os {g} são uma praga", "os {g} são vermes e deviam ser expulsos", "todos os {g} fedem e roubam", "os {g} não são humanos", "deviam prender todos os {g}", "mandem os {g} de volta para o pântano deles", "os {g} estragam tudo o que tocam", "o mundo seria melhor sem os {g}", "os {g} são burros demais para ler", "odeio os {g}, são todos iguais", "os {g} não merecem votar"],
    "nl": ["{g} kun je nooit vertrouwen, die liegen vanaf hun geboorte", "{g} zijn ongedierte", "{g} zijn uitschot en moeten het land uit", "alle {g} stinken en stelen", "{g} zijn geen mensen", "sluit alle {g} op", "stuur de {g} terug naar hun moeras", "{g} maken alles kapot wat ze aanraken", "de wereld zou beter zijn zonder {g}", "{g} zijn te dom om te lezen", "ik haat {g}, ze zijn allemaal hetzelfde", "{g} verdienen het niet om te stemmen"],
}
SEXUAL = {
    "en": ["I want you naked in my bed", "send me nudes", "send nude pictures and I will tell you what I would do to your body", "I will lick every inch of your body", "i get so horny when i read this", "i touch myself on the sofa when i read this", "I masturbate to this chapter", "want to see me without clothes", "want to see me naked on my private cam", "i have a private cam, very dirty", "looking for hot singles who want sex tonight", "hot girls want dirty sex chat, message me", "no strings sex, message me", "they had sex on the kitchen table", "he pulled off her dress and they fucked all night", "she pulled down his trousers and took him in her mouth", "his hand slid between her thighs and she moaned", "the wet heat between her thighs", "he described her bare breasts and her wet thighs in detail", "his tongue moved down her belly until she came", "she came, shaking, with his fingers inside her", "her nipples hardened under his tongue", "he was hard and she rode him until he came", "I imagine you on your knees, undressing me", "undress me with your teeth", "moaning and naked on top of me", "I want to feel you inside me", "suck my cock", "your ass looks so hot, let me touch it", "he thrust into her again and again until she screamed", "let me undress you and kiss you all over"],
    "de": ["ich will dich nackt in meinem Bett", "schick mir Nacktbilder", "ich lecke dich am ganzen Körper", "ich bin so geil, wenn ich das lese", "er zog ihr das Kleid aus und sie hatten Sex auf dem Tisch", "seine Zunge glitt über ihren Bauch, bis sie kam", "sie stöhnte, als seine Hand zwischen ihre Schenkel glitt", "ich fasse mich selbst an, wenn ich das lese", "heiße Singles suchen Sex, schreib mir", "ich will dich stöhnen hören, nackt unter mir"],
    "fr": ["je te veux nue dans mon lit", "envoie-moi des photos de toi nue", "je vais lécher tout ton corps", "ça m'excite tellement que je me touche en lisant", "il lui arracha sa robe et ils baisèrent sur la table", "sa langue descendit sur son ventre jusqu'à ce qu'elle jouisse", "elle gémit quand sa main glissa entre ses cuisses", "je veux t'entendre gémir, nue sous moi", "célibataires chaudes pour du sexe, écris-moi"],
    "es": ["te quiero desnuda en mi cama", "mándame fotos desnuda", "voy a lamerte todo el cuerpo", "me pongo tan cachondo que me toco leyendo esto", "le quitó el vestido y follaron sobre la mesa", "su lengua bajó por su vientre hasta que ella se corrió", "ella gimió cuando su mano se deslizó entre sus muslos", "quiero oírte gemir, desnuda debajo de mí", "solteras calientes buscan sexo, escríbeme"],
    "pt": ["quero você nua na minha cama", "manda fotos suas pelada", "vou lamber o seu corpo inteiro", "fico com tanto tesão que me toco lendo isto", "ele tirou o vestido dela e transaram em cima da mesa", "a língua dele desceu pela barriga dela até ela gozar", "ela gemeu quando a mão dele deslizou entre as coxas dela", "quero ouvir você gemer, nua embaixo de mim", "solteiras quentes querem sexo, me escreve"],
    "nl": ["ik wil je naakt in mijn bed", "stuur me naaktfoto's", "ik lik je hele lichaam", "ik word zo geil dat ik mezelf aanraak als ik dit lees", "hij trok haar jurk uit en ze hadden seks op de tafel", "zijn tong gleed over haar buik tot ze klaarkwam", "ze kreunde toen zijn hand tussen haar dijen gleed", "ik wil je horen kreunen, naakt onder me", "geile singles zoeken seks, stuur me een bericht"],
}
#: Sober talk and harmless senses.
HARMLESS = {
    "en": ["you can write to me here and I will send you the copy", "my neighbour gave me the book and I never gave it back", "my cousin told me the same story", "I asked for the book and they sent it to my street", "ask for me at the library after six", "my name is on the first page and I have read it many times", "this happened to me and my friend years ago", "signed, a happy reader", "best wishes to all of you from the reading group", "post it to my old address please", "you never asked for the letter, and I never sent it", "our doctor said the same about tiredness", "we meet at the corner house every Sunday", "the {g} in the story bury their dead at sea", "the {g} and the {g} share one well in this book", "the chapter about the {g} moved me", "the book shows how the {g} are taught to hate themselves", "the author treats the {g} with respect", "the {g} were driven from their homes in this chapter, and it made me cry", "{g} read this book differently, and I would like to hear why", "I felt like an idiot for missing the hint", "idiot is an old word in this novel, not an insult", "the villain calls her worthless and the author judges him for it", "he calls her a {i} in front of the guests, and the silence judges him", "the threats of the villain are cheap and old", "I could kill for a cup of tea", "I want to kill this habit of reading the end first", "this sentence killed me, it is so beautiful", "it is a damn good book and I cried like hell", "hell, for this narrator, is a room", "the bitch had six puppies and he kept one", "the ass and the cock in the stable are honest creatures", "the bastard son of the duke inherits nothing", "the doctor talks about breast cancer and sex education", "the sex of the child is never told", "her naked grief made me close the book", "the naked, wintry trees in the chapter about the garden", "it was stupid of me to skip this chapter", "a stupid mistake of mine cost us the evening", "the dumb show in the second act is long", "Dick, as his friends call him, is the hero", "he damns himself with one careless sentence", "the old people in the village know the story", "women in this novel carry the plot", "the slave is beaten in this scene, and it is hard to read", "she was raped, the court says, and the book never describes it", "the murder in chapter nine is told without blood", "I hate the ending but love the book", "I hate how slow the middle is", "shut the door, she says, and nobody moves", "the pig is the cleverest animal in the story", "the thick fog and the dirty river", "get some sleep before you read the end", "he touched the letter and kissed her hand", "she undressed in the dark and went to sleep alone", "thanks, you are too kind", "you were right about the ending", "what a wonderful reader you are", "I know where you live in the story now, what a lovely street", "lol yes", "same here", "ok, see you on Sunday", "no spoilers please", "have you tried the new translation", "sorry for the late answer, work was rotten", "send me the page number please", "call me after six", "come over on Sunday and bring the book", "message me when you reach the end", "I am looking for the second volume", "you can trust the narrator in this one", "she wants to see the sea without her father", "nobody likes the uncle, nobody reads his letters", "the people in the thread know this book well", "a useless argument about hope", "the worthless coin buys her freedom"],
    "de": ["schreibt mir einfach, dann schicke ich euch die Datei", "ruft mich an, meine Nummer steht unten", "meine Nachbarin hat mir das Buch geliehen", "ich wohne neben der Kirche", "schickt das Buch bitte an meine Straße", "auf der letzten Seite hatte ich alles verstanden", "viele Grüße aus dem Lesekreis", "meine Nummer steht auf dem Formular", "die {g} in der Geschichte begraben ihre Toten am Meer", "das Kapitel über die {g} hat mich bewegt", "Idiot ist hier ein altes Wort und keine Beleidigung", "ich kam mir dumm vor, weil ich den Hinweis übersah", "der nackte Schmerz dieser Szene", "das Schwein ist das klügste Tier der Geschichte", "ich hasse dieses Ende und liebe das Buch", "verdammt gutes Buch", "ruf mich am Abend an", "schreib mir, wenn du fertig bist"],
    "fr": ["vous pouvez m'écrire pour avoir la version longue", "appelez-moi le soir, mon numéro est le même", "ma voisine m'a prêté le livre", "j'habite rue de l'église, à côté de l'école", "envoyez le livre à mon avenue", "à la dernière page, personne ne viendrait plus", "on disait au village que personne ne savait", "bien à vous, une lectrice", "mon numéro est dans le formulaire", "les {g} de l'histoire enterrent leurs morts en mer", "le chapitre sur les {g} m'a émue", "je me suis sentie bête d'avoir manqué l'indice", "la douleur nue de cette scène", "le cochon est l'animal le plus malin de l'histoire", "je déteste cette fin mais j'aime le livre", "le pauvre garçon perd tout", "écris-moi quand tu auras fini", "appelle-moi le soir"],
    "es": ["pueden escribirme y les mando el archivo", "manden el libro a mi avenida", "mi número es el mismo de siempre", "mi vecina me prestó el libro", "vivo en la calle de al lado", "un abrazo de una lectora", "mi documento sigue en el formulario", "en la última página ya no iba a venir nadie", "los {g} de la historia entierran a sus muertos en el mar", "el capítulo sobre los {g} me conmovió", "me sentí tonta por no ver la pista", "el dolor desnudo de esta escena", "el cerdo es el animal más listo de la historia", "odio este final pero amo el libro", "escríbeme cuando termines", "llámame por la tarde", "la basura del patio vuelve en el último capítulo"],
    "pt": ["podem me escrever que eu mando o arquivo", "mandem o livro para a minha avenida", "o meu número é o mesmo de sempre", "a minha vizinha me emprestou o livro", "moro na rua ao lado da escola", "um abraço de uma leitora", "o número da minha carta ainda está no formulário", "na última página ninguém viria", "os {g} da história enterram os seus mortos no mar", "o capítulo sobre os {g} me comoveu", "me senti burra por não ver a pista", "a dor nua desta cena", "o porco é o animal mais esperto da história", "odeio este final mas amo o livro", "me escreve quando terminar", "liga para mim de noite", "o palhaço da feira chora no último capítulo"],
    "nl": ["mail me gerust, dan stuur ik het bestand", "stuur het boek naar mijn straat", "mijn nummer is nog hetzelfde", "mijn buurvrouw heeft me het boek geleend", "ik woon naast de school", "groeten van een lezeres", "mijn nummer staat nog op het formulier", "op de laatste bladzijde zou er niemand meer komen", "de {g} in het verhaal begraven hun doden op zee", "het hoofdstuk over de {g} raakte me", "ik voelde me dom omdat ik de hint miste", "het naakte verdriet van deze scène", "het varken is het slimste dier van het verhaal", "ik haat dit einde maar hou van het boek", "schrijf me als je klaar bent", "bel me vanavond", "de dikke mist en het vuile water"],
}
_DISGUISE = str.maketrans({"i": "1", "o": "0", "a": "@", "s": "$", "e": "3"})


def disguise(word: str, rng: random.Random) -> str:
    """A rude word as it is written to pass a filter."""
    k = rng.randrange(4)
    if k == 0 and len(word) > 3:
        at = rng.randrange(1, len(word) - 1)
        return word[:at] + "*" + word[at + 1 :]
    if k == 1:
        return word.translate(_DISGUISE)
    return " ".join(word) if k == 2 and " " not in word and len(word) < 7 else word


def rows(seed: int = 11, each: int = 6) -> list[tuple[str, str]]:
    """(text, category) rows made from the frames."""
    rng = random.Random(seed)
    out: list[tuple[str, str]] = []
    for lang in GROUPS:
        for category, frames in (("abuse", ABUSE), ("hate", HATE), ("sexual", SEXUAL), ("none", HARMLESS)):
            for frame in frames[lang]:
                free = frame.count("{")
                for _ in range(each if free else 2):
                    insult = rng.choice(INSULTS[lang])
                    text = frame.format(i=disguise(insult, rng) if rng.random() < 0.25 and category == "abuse" else insult, r=rng.choice(RUDE[lang]), g="{}")
                    groups = itertools.cycle(rng.sample(GROUPS[lang], 2))
                    while "{}" in text:
                        text = text.replace("{}", next(groups), 1)
                    out.append((text, category))
    return out
