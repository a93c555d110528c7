"""Words by what they do in an abusive, hateful or sexual sentence (problem 10).

General Spanish and English vocabulary, by class; the grammar in ``abuse`` says which
classes in which order make a case. No class holds sentences of any corpus.
"""

from __future__ import annotations

# Words that insult whoever they are said of.
INSULT = """imbecil idiota idiot pendejo tarado cretino gilipollas malnacido malparido cabron hijueputa hijodeputa hijaputa culero gonorrea
    pelotudo boludo huevon comemierda lameculos mamarracho zorra ramera asshole bastard moron scumbag dumbass dickhead jackass motherfucker retard imbecile
    douchebag cunt whore slut wanker dipshit bitch subnormal mongolico descerebrado zopenco mequetrefe sabandija bellaco gentuza""".split()
# Words that insult a person, and are said of things as well.
WEAK = """estupido stupid tonto bruto inutil useless ignorante payaso clown miserable pathetic fracasado loser perdedor cobarde coward vago lazy flojo haragan sucio
    dirty filthy asqueroso disgusting repugnante feo fea ugly ridiculo pedazo porqueria mierda shit puta puto crap worthless dumb fool bobo loco loca psicopata enfermo
    parasito parasite monstruo infeliz desgraciado sinverguenza degenerado mediocre retrasado retrasada ladron ratero thief mentiroso liar escoria scum basura trash garbage
    maldito malvado incompetente corrupto vendido hipocrita cochino mugroso mugriento patetico amargado cornudo arrastrado lambiscon chismoso metiche entrometido naco corriente mantenido
    vividor estafador tramposo rufian canalla patan bribon granuja traidor ingrato maleducado grosero prepotente arrogante enano gordinflon engendro adefesio esperpento mamon bastardo
    demente chiflado lunatico lunatic borracho drogadicto alcoholico solterona inepto incapaz tarugo menso necio lento torpe nefasto despreciable repulsivo inservible acomplejado resentido
    freak creep creepy weirdo psycho jerk prick twat dimwit halfwit nitwit buffoon lowlife degenerate cheater crook fraud hag fatso swine leech filth nasty vile hideous hopeless brainless
    clueless incompetent drunk junkie ignorant idiotic moronic pitiful spineless rude shameless failure joke embarrassment disgrace cretin villain skank tramp""".split()
# Of these the ones that are said of things, so that they need a person close by.
SAID_OF_THINGS = """tonto bobo necio menso estupido stupid bruto inutil useless sucio dirty filthy asqueroso disgusting repugnante feo fea ugly ridiculo pedazo porqueria mierda shit puta puto crap worthless dumb loco loca
    enfermo retrasado retrasada basura trash garbage maldito vendido corriente lento torpe inservible nasty hideous hopeless idiotic joke crazy falso enano creepy bastardo clown payaso fool freak
    fraud robo lazy vago flojo corrupto pitiful miserable pathetic patetico thief ladron mediocre nefasto vile rude failure embarrassment disgrace""".split()
# Animals and ages used as insults.
BEAST = "animal cerdo puerco pig perra perro dog rata rat burro asno donkey mula gusano worm cucaracha cockroach vibora bestia cow vaca gordo fat vieja viejo bruja witch lacra mono simio monkey ape foca ballena whale zopilote alimana zancudo garrapata tick rodent snake culebra lagarto sapo toad cabra goat gallina chicken hiena hyena mosca pulga".split()
SWEAR = "maldito maldita malditos malditas mierda puto puta fucking damn goddamn bloody pinche jodido condenado".split()
# Who is spoken to, who is spoken of.
YOU = "vos usted ustedes tu tus eres sos sois you your youre yourself u ur vosotros".split()
PERSON = """cajero cajera gerente encargado vendedor vendedora repartidor guardia agente supervisor supervisora jefe jefa dueno empleado dependiente senor senora tipo tipa
    vecino moderador administrador admin chofer mesero cocinero carnicero doctor maestro cashier manager seller clerk driver owner boss employee guard waiter agent
    guy man woman lady author reviewer customer cliente familia family madre mother mama padre father hermano hermana hijo hijos hija kid mom dad persona person""".split()
COPULA = "es son era fue eran is are was were parece parecen seems looks look sounds be being son".split()
FILLER = "un una unos unas el la los las tan mas muy bien a an the so such very que todo toda todos total complete really just siempre solo y and pobre grandisimo little big old real absolute otro peor worst gran puro pura verdadero verdadera completo completa totally pure bunch fucking damn as como eso ese esa nada mas my mi nuestra nuestro".split()
COLLECTIVE = "partida bola manga sarta panda hatajo pandilla punado bunch pack gang".split()
# Beginnings of verbs and words of violence, parts of the body, weapons.
VIOLENCE = "paliz golpiz mata mato quema quemo romp revent reviento parto partir parti golpe pego pegar acuchill apunal machet dispar estrangul ahorc tortur patea destroz desmadr hund kill murder beat break smash burn stab shoot hurt strangl punch slap crush choke bury".split()
BODY = "cara boca dientes cabeza cuello hocico huesos piernas pierna mano manos jeta nariz face mouth teeth head neck bones legs leg hands hand nose skull fingers espalda".split()
WEAPON = "machete pistola cuchillo navaja bate bala balazo tiro tiros gun knife bullet bat rifle palo piedra fuego".split()
HARM = "muerto muerta cancer muera mueras mueran morir morirte die dies dead choke atropelle atropellen hurt pudras pudra rot cancer queme quemen maten maltraten parta hospital cuneta cementerio grave hell infierno".split()
LIVE = "vivis vives vive viven live lives sleep duermes duermen trabaja trabajas trabajan work works park parks estacionas parqueas estudia estudian go goes va van".split()
LIKED = "quiere quiera soporta aguanta extranara extranar extrana miss likes like loves love cares care ama necesita needs want wants respeta pregunto preguntado asked escucha".split()
LEAVE = "callate callense cierra largate larguese andate vete vayanse lárgate quitate shut".split()
SELF_HARM = "matate ahorcate suicidate muerete pegate colgate matense suicidense".split()
# Groups of people, as plurals.
GROUPS = """mujeres hombres gays lesbianas homosexuales bisexuales transexuales trans travestis negros indios indigenas chinos arabes judios musulmanes cristianos evangelicos catolicos
    mormones hindues ateos haitianos venezolanos nicas nicaraguenses salvadorenos guatemaltecos hondurenos mexicanos cubanos colombianos peruanos bolivianos africanos asiaticos rusos
    gringos gitanos extranjeros inmigrantes migrantes refugiados ancianos viejos discapacitados lisiados minusvalidos autistas ciegos sordos pobres campesinos mestizos fanaticos
    women gays lesbians homosexuals transgenders blacks jews muslims christians catholics hindus mexicans immigrants migrants foreigners refugees natives indians asians arabs africans
    latinos hispanics gypsies elderly disabled""".split()
GROUP_PHRASES = "black people;white people;old people;poor people;disabled people;gay people;trans people;brown people;indigenous people;people of that religion;esa religion;that religion;esa raza;that race;those people;esa gente".split(";")
SLURS = "maricon marica maricones maricas sudaca sudacas negrata faggot faggots fag fags nigger niggers nigga kike kikes spic spics wetback wetbacks chink chinks tranny trannies dyke beaner beaners raghead marimacho".split()
# What is said of groups to degrade them, and of what should be done to them.
DEGRADING = """inferior inferiores plaga peste escoria scum parasitos parasite parasites vermin pests abominacion abomination inmunda inmundo inmundos asco asquerosos asquerosas disgust disgusting disgusts
    terroristas terrorists criminales criminals delincuentes delincuencia violadores rapists ladrones thieves thief roban steal steals maldad evil estorbo burden carga brutos brutas stupid estupidos
    estupidas idiotas idiots inutiles useless flojos vagos lazy haraganes hipocritas sucios sucias dirty filthy apestan stink animales animals bestias ratas rats cucarachas roaches cerdos pigs basura trash
    garbage enfermos freaks ill robando robar quitan delincuente inferioridad invaden vividores mantenidos huevones corruptos mentirosos liars lice piojos monos monkeys apes simios perros dogs vagabundos drogadictos puercos cochinos ignorantes ignorant tontos tontas dumb locos inservibles haraganas malos
    enfermos sick salvajes savages subhuman gentuza mierda ruin degenerados pervertidos peligro cancer brutes beasts maldicion""".split()
EXCLUDING = """prohibir prohibirles prohibirse ban banned expulsar expulsarlos echar echarlos sacarlos fuera larguen larguense regresen deport deported deportar deportarlos exterminar exterminarlos
    exterminate eliminar eliminarlos mueran morirse starve hang desaparezcan desaparecer encerrar locked castrar castrate burn shoot esclavos slaves kill gas quemarlos matarlos merecen deserve""".split()
# Sexual words and what they add; words of the context add less.
SEXUAL = {
    1.0: """porno pornografico pornografia porn xxx nudes mamada chupamela mamamela blowjob handjob pussy tits follar follarte follarme follame cogerte cogerme cogeme culear culearte horny masturbar
        masturbo masturba masturbarme masturbarte masturbate masturbating orgasmo orgasm eyacular cum deepthroat threesome gangbang creampie milf encuerada boobs tetas""".split(),
    0.7: "escort prostituta prostituto prostitute nalga culo verga encuerado desnuda desnudo naked nude gemir gime gimes gimiendo gemido moan moaning sexo sex lamer lamerte lamerlas lamerla lick licking chuparte chuparlas chuparla suck cock dick puta erotico erotica pechos senos genitales lesbico follada cogida cogiendo penetrar penetrarte penetracion clitoris manosear grope striptease coito".split(),
    0.5: "sexual pezones pezon pelota pelotas caliente tocate tocarte touch chupar fuck fucking screw bang ass tanga intimas intimos agacharse agachada moja mojas mojada hard dura prepago puta putas cachonda sexy".split(),
    0.3: "chicas girls cama bed bedroom noche night tonight limites limits falda skirt blusa blouse undress cuerpo body gritar masaje masajes massage foto fotos pics photos picture video videos clips mandame send uniforme uniform oral debajo under hotel compania imagino pack dinero casual interior encuentros feliz yourself".split(),
}
# Contexts that speak of it without being it.
MODERATION = "eliminado elimino eliminada retirado retiro removido borrado borro bloqueado reportado reporto denunciado moderador moderacion filtro politica normas removed deleted flagged reported moderator moderation policy filter hidden".split()
HEALTH = "condon condones preservativo preservativos anticonceptivo anticonceptivos lubricante ginecologo salud educacion higiene jabon toalla toallas prueba embarazo infeccion farmacia health hygiene condoms medical vih consulta crema lactancia bebe baby cream".split()

#: Small words that join the others in a sequence written without blanks.
SMALL = "de la el los las en a y que esa ese es un una son of the is are you me te no tu mi se".split()
