"""Sentences written for the tests, none of them from the tables.

They were written in four batches, each before the scorer had seen it. At first sight the
last three gave 23 of 40, 25 of 35 and 27 of 40 cases and 1 of 70 harmless sentences; what
they missed then went into the lexicon and the grammar.
"""

ABUSIVE = """
Te voy a matar, maldita bruja
Kill yourself, nobody will notice
Eres una inútil buena para nada y siempre lo serás
Qué clase de gerente tan estúpido tienen ustedes
Sos más tonto que una piedra, dejá de opinar
Ojalá te atropelle un bus mañana
Vuelvo a verte por aquí y te parto la boca
I hope you choke on it and die
You are a pathetic little man
Shut your mouth, you disgusting pig
The guy who wrote this review is a complete retard
I know where you live and I am coming for you
Sé dónde trabaja tu mamá, te vas a arrepentir
Ese vendedor es un hijo de la gran puta
La señora de la caja es una vieja ridícula y tarada
Cállate el hocico, gusano asqueroso
Nadie te va a extrañar cuando te mueras
Usted es un miserable y un ladrón
Te vamos a quemar el carro si volvés
We will burn your house down tonight
Go to hell, you filthy bastard
El repartidor es un pedazo de basura humana
Vos no servís para nada, fracasado
You are so dumb that even your mother is ashamed
Your whole family is trash and so are you
Mejor pegate un tiro y nos hacés un favor
Sos una p3nd3j4 sin cerebro
Eres un 1d10t4 y un cobarde
What a m0r0n, you can't even count
I will smash your face the next time I see you
El encargado es un cochino mentiroso y un vago
Qué asco de persona sos, das vergüenza
I swear I will beat you up if you come back
Nobody wants you here, freak
Su hija es una cualquiera y usted un cornudo
You ignorant fool, learn to read
Vas a terminar muerto si seguís hablando
Sos la peor escoria que he conocido
Al gerente hay que darle una paliza
Your wife is an ugly cow
Los empleados son unos inútiles y unos rateros
Te crees muy lista pero sos una burra
Esa cajera es una amargada y una estúpida
Ojalá le dé cáncer al dueño
Eres patético, das risa
Stupid woman, go back to school
They should fire that useless idiot
te voy a reventar a golpes
Maldito viejo cochino, ya morite
You people behind the counter are a bunch of morons
El del mostrador es un patán y un mentiroso
You are nothing but a lying thief
Sos una basura de persona y lo sabés
Ojalá te parta un rayo, desgraciado
Te voy a moler a palos si no me devolvés el dinero
Cállese, vieja chismosa
What an ignorant clown you are
Esa vendedora es una inepta y una grosera
I am going to beat your face in
No tenés cerebro, animal
Son unos imbéciles los de la sucursal
Su madre debió abortarlo
You should be ashamed, you stupid cow
Aquí te espero con la pistola, cobarde
Nobody likes you, go hang yourself
La gerente es una arrogante y una corrupta
Sos un perdedor, ni tu perro te quiere
You stupid liar, give me my money back
Ojalá choques y te mueras
Te voy a sacar los dientes a golpes
Ese guardia es un abusivo, un animal sin educación
Callate, gorda asquerosa
I hope someone stabs you
Qué idiotas son los que atienden aquí
We know where your children go to school
El dueño es un viejo tacaño y explotador
Your face makes me want to vomit
Vos sos el payaso más grande de esta tienda
Get lost, you worthless piece of garbage
La que me atendió es una tarada
Mejor matate, nadie lo va a notar
Señora, usted es una ignorante
That driver is a dirty rat
Te voy a cortar el cuello
Eres más feo que un susto, bestia
""".strip().splitlines()

HATEFUL = """
All Muslims are terrorists and must be deported
Los haitianos son una plaga que hay que sacar del país
Gays should be locked up, they are sick
Los indios son sucios y flojos por naturaleza
Jews control everything and ruin this country
Las mujeres son brutas, no deberían votar
No se puede confiar en los gitanos, todos roban
Black people are too stupid to run a shop
Fuera los venezolanos, que se larguen a su país
Immigrants are parasites living off our taxes
Los discapacitados son un estorbo para la sociedad
Esos negros de mierda solo traen delincuencia
Old people are useless and should just die already
Hay que exterminar a los homosexuales
Los evangélicos son todos unos ratas hipócritas
Foreigners are criminals, send them back
Los pobres son basura, no merecen comer
Women belong in the kitchen, they are too stupid for business
Mexicans are dirty and lazy
A los ch1n0s habría que prohibirles la entrada, son asquerosos
No quiero travestis en esta tienda, son una abominación
Christians are idiots and should be banned
Los migrantes son animales y deberían morirse de hambre
These f4gg0ts make me sick
Esos judíos solo piensan en dinero y nos roban a todos
Women are inferior and should obey
No contraten a gays, son un peligro para los niños
Los indígenas apestan y no saben trabajar
Send the refugees back where they came from
Asians eat dogs, disgusting people
Los viejos ya no sirven, que se mueran de una vez
Hay demasiados nicas robando trabajo, fuera del país
Trans people are mentally ill freaks
A los negros no los dejen entrar
Los musulmanes son terroristas y hay que echarlos
Never hire Mexicans, they steal everything
Las mujeres manejan mal y solo sirven para cocinar
Gypsies are filthy thieves
Deberían prohibir a los gays entrar a la tienda
Los haitianos huelen mal y traen enfermedades
Disabled people are a burden on society
Malditos judíos, controlan todo
All immigrants should be sent back to their country
Esos maricas dan asco
Los colombianos son todos narcos y ladrones
Women are too dumb to drive
Esta tienda se llenó de maricones, qué asco
Los sordos son un estorbo en la fila
Deport every single immigrant, they are vermin
No le vendan a los indios, son unos borrachos
Muslims should not be allowed in this store
Los gays están enfermos, hay que encerrarlos
Blacks are lazy and they steal
Que se mueran todos los judíos
""".strip().splitlines()

SEXUAL = """
Show me your boobs
V3t3 @ l4 v3rg4 y chúpamela
Quiero chuparte las tetas
I want to lick your pussy right now
Busco mujer para sexo casual esta noche
Mandame una foto de tus nalgas
Escorts disponibles a domicilio, servicio completo
Se masturba pensando en la vecina
Send me a picture of your naked body
Le quiero meter la verga hasta el fondo
Nice ass, I would bang you all day
Videos XXX caseros, escríbeme por privado
Estoy caliente y quiero coger contigo
Blowjob for twenty dollars behind the store
Me encanta cuando gimes y te mojas
Vendo pack de fotos íntimas sin ropa
Her tits make me so hard
Prepagos y putas baratas, llame ya
Quiero verte en tanga y tocarte toda
Let's have sex in the stockroom
Quiero que me hagas una m4m4d4
Hot n.u.d.e.s for sale, DM me
Quiero verte desnuda en mi cama
Te la quiero meter toda
Looking for girls to have sex tonight
Mándame tu pack, mi amor
Grabé a mi novia teniendo sexo y vendo el video
Suck my dick
Qué ricas piernas, te haría mía toda la noche
Putas a domicilio, llamá al número
Your ass looks so good in those jeans, come to my bed
Le toqué los pechos a la cajera y le gustó
Quiero lamerte todo el cuerpo
Selling my used panties and nude pics
Te espero desnuda en el motel
She gave me a blowjob in the parking lot
Contactame para sexo sin compromiso
Me masturbo viendo tus fotos
I want to see you naked tonight
Chicas calientes disponibles toda la noche
Qué buen culo tiene la cajera, me la quiero coger
Grab her tits and moan
Me excita verte en falda, quiero tocarte
Send nudes and I will give you a discount
Busco señora para coger esta noche
He showed me his dick in the store
Vendo videos porno caseros
Te quiero chupar los pezones
My wife likes to watch while I fuck the neighbor
Servicio sexual completo, chicas jóvenes
Se le ven las tetas en la foto, qué rica
Come over and ride me all night
""".strip().splitlines()

CLEAN = """
Usted es un excelente cajero y una gran persona
Watch your back pain with this heating belt
Con mi vecina compramos frijoles al por mayor
La carne de cerdo subió otra vez esta semana
Este detergente es una basura, no quita nada
The price is stupid high for a bag of rice
Mataron los precios con esa promoción
Toallas sanitarias para mujeres, paquete de doce
Las mujeres de mi familia prefieren esta marca
Muchos migrantes compran aquí porque es barato
Los chinos del barrio venden buen arroz
Old people get a ten percent discount on Tuesdays
Black beans and white rice, two bags each
Pechugas de pollo sin hueso, bandeja familiar
Leche de coco, la mejor para postres
Condones texturizados, caja con tres unidades
Lubricante íntimo a base de agua
Prueba de embarazo y anticonceptivos en el pasillo cinco
The moderator removed a comment with sexual content
Se eliminó una reseña por insultos y amenazas
El contenido pornográfico fue retirado por el equipo
Se me rompió la bolsa y perdí todo el arroz
Te voy a esperar en la entrada con las bolsas
I will find you a cheaper brand tomorrow
Nobody beats these prices
Qué rico el chocolate negro con naranja
Me muero por probar ese queso
Mi mamá dice que el precio es una locura
El perro de mi vecino come este alimento
Alimento para perras gestantes, saco de ocho kilos
Trampa para ratas y cucarachas, dos unidades
Insecticida mata moscas y cucarachas al instante
This product is useless, waste of money
El servicio es pésimo y la fila eterna
La cajera fue muy amable conmigo
El gerente me devolvió el dinero sin problema
Me cobraron doble y nadie responde, qué robo
Son unos precios de ladrones, no vuelvo
Ese precio es un insulto para el cliente
Huevos de gallina criolla, docena
Tetero para bebé con mango, tres piezas
Pan duro como piedra, qué decepción
Crema para el dolor de espalda y golpes
El sostén de algodón talla media sale bien
Ropa interior para hombre, tres piezas
Camisa sin mangas para dama, talla grande
Desnudamos los precios: todo a mitad
Animal feed, fifty pound bag
Don't be shy, try the new flavor
The baby wipes are soft and safe
Las personas mayores pagan menos los martes
Rampa para personas con discapacidad en la entrada
La tienda contrata mujeres y hombres sin experiencia
Foreign cheese is in aisle nine
Jewish rye bread, sliced
Se queman los frijoles si no los movés
Golpe de precios este fin de semana
Tus hijos van a amar este cereal
Estás loco si pagás ese precio por la leche
Corten la cebolla y maten el hervor con agua fría
Gusanos de goma ácidos, bolsa de cien gramos
Salchichas gruesas para asar
Chupetes de fresa, bolsa de veinticuatro
The chicken breast was dry and the cock-a-leekie soup salty
Coger el bus hasta la tienda sale más caro que el ahorro
Recoger el pedido en la puerta trasera
El cajero automático no sirve desde ayer
Sirve para limpiar pisos y no huele mal
El perro de la señora es muy lindo
La vaca da leche entera
El dueño del local es amable
Compré una muñeca para mi hija y le encantó
La crema para manos huele rico
I hope you enjoy the new recipe
You are the best customers
El guardia me ayudó con las bolsas
Los viejos clientes reciben descuento
Las mujeres embarazadas tienen fila preferencial
Don't waste your money, this blender is trash
The pan broke in my hands
Corte el pollo en piezas y golpee la carne
Mate el antojo con churros
La sopa quedó asquerosa, no la compren
Qué porquería de servicio
Estúpido empaque, no abre
Sexo del bebé: niña, pañales talla dos
Una noche de película con palomitas
Quiero ver precios de la cama matrimonial
Precios bajos toda la noche
Hot dogs para la parrilla
Pollo desnudo de grasa
La mierda de licuadora dejó de servir
Me siento robado con este aumento
Vos podés encontrar mejores precios
¿Usted sabe si hay leche sin lactosa?
No quiero pagar tanto por frijoles negros
Indios y mestizos conviven en mi pueblo
Te espero en la salida del súper a las cinco
El pollo estaba crudo y el cajero no quiso cambiarlo
Los precios matan el bolsillo
My dog loves this food
La carne molida huele mal, no la compren
Mujeres y hombres hacen fila aparte en la caja rápida
I will never buy this garbage again
El jabón íntimo no irrita la piel
Pañales para bebé, noche completa
El burro de planchar salió defectuoso
Las ratas se comieron el saco de arroz
Golpearon la caja en el envío
No sirve para nada este abrelatas
Old prices were better than these
Los chinos de la esquina abren más tarde
Qué estúpida promoción, no aplica nunca
Vino tinto para la cena de esta noche
The staff is slow but friendly
Usted merece mejores precios
Le quitaron la piel al pollo
Chorizo grueso y jugoso para la parrilla
El dueño del perro pagó en efectivo
La señora mayor me ayudó a encontrar la leche
I hope the price drops soon
Te voy a mandar la factura por correo
El cuello de la botella venía quebrado
Se quemó la licuadora a los dos días
The dirty floor made me leave the store
Los ciegos pueden pedir ayuda en la entrada
Las mujeres compran más los sábados
Nos atendió un joven sordo muy amable
Los precios están locos este mes
El gato come esta marca sin problema
This is the worst rice I have ever bought
Pésima atención, nunca contestan el teléfono
Cuchillo de cocina con mango de madera
Chocolate caliente para las noches frías
Quiero probar la crema de noche para la cara
Ladrillos y sucios escombros en la bodega
Cobran hasta por respirar en ese supermercado
La foto del producto no coincide con lo que llegó
""".strip().splitlines()
