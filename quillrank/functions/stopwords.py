"""Lists of function words for 17 languages.

The English list is the classic one of 33 words. The lists of other European languages go by word class, as those of the Snowball project do (which are
free under a BSD licence): articles, pronouns, prepositions and conjunctions, and the forms of auxiliaries. Those of Romanian, Turkish, Arabic and
Hindi are short lists of our own. Callers with a list of their own give it to the tokenizer.
"""

from __future__ import annotations

_LISTS = {
    "english": "the of and to in is that it for was on are as with they be at this or by but not there an will their such if then into these no a",
    "german": "der die das des dem den ein eine einer eines einem einen dieser diese dieses diesem diesen jener jene jenes jenem jenen jeder jede jedes jedem jeden welcher welche welches welchem welchen mancher manche manches manchem manchen solcher solche solches solchem solchen aller alle alles allem allen anderer andere anderes anderem anderen ander andern anderm derselbe dieselbe dasselbe desselben demselben denselben dieselben ich mich mir du dich dir er ihn ihm sie ihr es wir uns euch ihnen sich selbst man mein meine meiner meines meinem meinen dein deine deiner deines deinem deinen sein seine seiner seines seinem seinen ihre ihrer ihres ihrem ihren unser unsere unserer unseres unserem unseren euer eure eurer eures eurem euren kein keine keiner keines keinem keinen derer dessen wer wen wem was wie wo wenn weil während und oder aber denn sondern sonst als ob dass daß damit dann da dort hier hin hinter in im ins an am auf aus bei bis durch für gegen mit nach ohne über um unter von vom vor zu zum zur zwischen zwar nicht nichts nun nur noch auch so sehr schon doch jetzt also einige einiger einiges einigem einigen einmal etwas weg weiter wieder viel indem bin bist ist sind war warst waren hab habe haben hat hatte hatten werde werden wird wirst wurde wurden würde würden kann können könnte muss musste soll sollte will wollen wollte machen",
    "french": "le la les l un une des du de d à au aux ce ces cet cette ceci cela celà c je j me m moi tu te t toi il elle lui se s soi on nous vous ils elles eux leur leurs y en mon ma mes ton ta tes son sa ses notre nos votre vos qui que qu quel quelle quels quelles quoi dont où et ou mais ni car donc or si comme quand lorsque ne n pas plus par pour dans sur sous avec sans chez entre vers depuis pendant avant après même aussi très tout tous toute toutes être été étée étées étés étant suis es est sommes êtes sont serai seras sera serons serez seront serais serait serions seriez seraient étais était étions étiez étaient fus fut fûmes fûtes furent sois soit soyons soyez soient fusse fusses fût fussions fussiez fussent avoir ayant eu eue eues eus ai as a avons avez ont aurai auras aura aurons aurez auront aurais aurait aurions auriez auraient avais avait avions aviez avaient eut eûmes eûtes eurent aie aies ait ayons ayez aient eusse eusses eût eussions eussiez eussent",
    "spanish": "el la los las lo un una unos unas del al de que en y e o u a ante bajo con contra desde durante entre hacia hasta para por según sin sobre tras yo me mí tú te ti él ella ello nos nosotros nosotras vosotros vosotras os ellos ellas se sí le les mi mis tu tus su sus mío mía míos mías tuyo tuya tuyos tuyas suyo suya suyos suyas nuestro nuestra nuestros nuestras vuestro vuestra vuestros vuestras este esta esto estos estas ese esa eso esos esas aquel aquella quien quienes cual cuando donde como qué porque pero si no ni más muy mucho muchos poco ya también tanto todo todos algo algunos algunas nada otro otra otros otras uno antes es soy eres somos sois son sea seas seamos seáis sean seré serás será seremos seréis serán sería serías seríamos seríais serían era eras éramos erais eran fui fuiste fue fuimos fuisteis fueron fuera fueras fuéramos fuerais fueran siendo sido estoy estás está estamos estáis están esté estés estemos estéis estén estaba estabas estábamos estabais estaban estuve estuvo estuvieron estado estada estados estadas estad he has ha hemos habéis han haya hayas hayamos hayáis hayan habré habrá habrán había habías habíamos habían hube hubo hubieron habiendo habido tengo tienes tiene tenemos tenéis tienen tenga tendrá tenía tenían tuve tuvo tuvieron teniendo tenido",
    "italian": "il lo la i gli le l un uno una di a da in con su per tra fra ad al allo ai agli all agl alla alle del dello dei degli dell degl della delle dal dallo dai dagli dall dagl dalla dalle nel nello nei negli nell negl nella nelle sul sullo sui sugli sull sugl sulla sulle col coi contro e ed o ma se perché anche come dov dove che chi cui non più quale quanto quanti quanta quante quello quelli quella quelle questo questi questa queste si tutto tutti io tu lui lei noi voi loro mio mia miei mie tuo tua tuoi tue suo sua suoi sue nostro nostra nostri nostre vostro vostra vostri vostre mi ti ci vi ne c ho hai ha abbiamo avete hanno abbia abbiate abbiano avrò avrai avrà avremo avrete avranno avrei avrebbe avevo avevi aveva avevamo avevate avevano ebbi ebbe ebbero avesse avessero avendo avuto avuta avuti avute sono sei è siamo siete sia siate siano sarò sarai sarà saremo sarete saranno sarei sarebbe ero eri era eravamo eravate erano fui fosti fu fummo foste furono fossi fosse fossimo fossero essendo faccio fai facciamo fanno faccia farò farà faranno facevo faceva facevano fece fecero facendo sto stai sta stiamo stanno stia starà stavo stava stavano stette stando",
    "portuguese": "o a os as um uma uns umas de do da dos das em no na nos nas num numa por pelo pela pelos pelas para com sem sob sobre entre até à às ao aos e ou mas que se como quando porque qual quem onde não mais muito muita já também só mesmo depois antes ainda eu me mim tu te você vocês ele ela eles elas nós lhe lhes meu minha meus minhas teu tua teus tuas seu sua seus suas nosso nossa nossos nossas dele dela deles delas este esta estes estas isto esse essa esses essas isso aquele aquela aqueles aquelas aquilo nem há estou está estamos estão estive esteve estivemos estiveram estava estávamos estavam esteja estejamos estejam hei havemos hão houve houveram haja hajam haver sou és somos são era éramos eram fui foi fomos foram fora seja sejamos sejam fosse fossem for forem serei será seremos serão seria seriam ser sendo sido tenho tem temos têm tinha tínhamos tinham tive teve tivemos tiveram tenha tenham tivesse tivessem terei terá terão teria teriam ter tendo tido",
    "dutch": "de het een en van ik te dat die in hij niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere",
    "russian": "а в ж и к о с у я да за на об ее же не уж из ли ни ей им он во до но по со то от ну их бы вы мы ты два она над под где нее уже мне все еще раз без или они при три эти ней мой как так был вам сам там тем чем ним том его про кто что вас нас нет вот тот тут ему эту них всю для моя куда была чтоб себе даже тоже если были этой этом один него чего того надо было этот всех ведь хоть есть чуть быть свою себя тебя меня когда тогда вдруг перед разве более после лучше через почти какой такой зачем потом всего много этого можно будто будет может между чтобы жизнь здесь опять какая всегда иногда больше другой сказал совсем ничего только хорошо сейчас потому нибудь теперь нельзя никогда сказала человек говорил впрочем конечно наконец сказать сегодня кажется",
    "swedish": "och det att i en jag hon som han på den med var sig för så till är men ett om hade de av icke mig du henne då sin nu har inte hans honom skulle hennes där min man ej vid kunde något från ut när efter upp vi dem vara vad över än dig kan sina här ha mot alla under någon eller allt mycket sedan ju denna själv detta åt utan varit hur ingen mitt ni bli blev oss din dessa några deras blir mina samma vilken er sådan vår blivit dess inom mellan sådant varför varje vilka ditt vem vilket sitta sådana vart dina vars vårt våra ert era vilkas",
    "norwegian": "og i jeg det at en et den til er som på de med han av ikke ikkje der så var meg seg men ett har om vi min mitt ha hadde hun nå over da ved fra du ut sin dem oss opp man kan hans hvor eller hva skal selv sjøl her alle vil bli ble blei blitt kunne inn når være kom noen noe ville dere deres kun ja etter ned skulle denne for deg si sine sitt mot å meget hvorfor dette disse uten hvordan ingen din ditt blir samme hvilken hvilke sånn inni mellom vår hver hvem vors hvis både bare enn fordi før mange også slik vært begge siden henne hennar",
    "danish": "og i jeg det at en den til er som på de med han af for ikke der var mig sig men et har om vi min havde ham hun nu over da fra du ud sin dem os op man hans hvor eller hvad skal selv her alle vil blev kunne ind når være dog noget ville jo deres efter ned skulle denne end dette mit også under have dig anden hende mine alt meget sit sine vor mod disse hvis din nogle hos blive mange ad bliver hendes været thi jer sådan",
    "finnish": "olla olen olet on olemme olette ovat ole oli olisi olisit olisin olisimme olisitte olisivat olit olin olimme olitte olivat ollut olleet en et ei emme ette eivät minä minun minut minua minussa minusta minuun minulla minulta minulle sinä sinun sinut sinua sinussa sinusta sinulla sinulle hän hänen hänet häntä hänessä hänestä hänellä hänelle me meidän meidät meitä meillä meille te teidän teidät teitä teillä he heidän heidät heitä heillä tämä tämän tätä tässä tästä tähän tällä tuo tuon tuota tuossa se sen sitä siinä siitä siihen sillä sille nämä näiden näitä näissä nuo ne niiden niitä niissä kuka kenen ketä ketkä mikä minkä mitä missä mistä mihin joka jonka jota jossa josta johon jolla jotka joiden joita että ja jos koska kuin mutta niin sekä tai vaan vai vaikka kanssa mukaan noin poikki yli kun nyt itse myös vain",
    "hungarian": "a az egy be ki le fel meg el át rá ide oda szét össze vissza de hát és vagy hogy van lesz volt csak nem igen mint én te ő mi ti ők ön ez azt ezt ebben abban ennek annak erre arra ezek azok ezért azért akkor amikor amely amelyek ami aki akik ahol mert míg még már majd most is sem se ha ahogy úgy így olyan ilyen minden mindig valami valaki néhány sok több nagyon között után alatt által szerint saját maga pedig azonban viszont tehát illetve vele neki nélkül lett lenne lehet legyen voltam voltak vagyok vagyunk vannak nincs kell tovább újra ott itt",
    "romanian": "și de la în a cu pe nu că o un este din se mai să ce le care ca pentru au sau dar el ea fi am ai prin",
    "turkish": "ve bir bu da de için ile çok ne o gibi ama daha mi kadar sonra olan ben sen biz siz onlar her ya ki",
    "arabic": "في من على إلى أن عن ما هذا لا التي هو مع كان هذه كل بعد قد ذلك أو بين هي لم ثم",
    "hindi": "के का की है में से को और पर यह ने एक कि हैं भी नहीं तो ही था वह इस जो कर हो लिए",
}

#: ISO codes, and Tamil, of which there is no list.
CODES = {"en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch", "ru": "russian", "sv": "swedish", "no": "norwegian", "nb": "norwegian", "nn": "norwegian", "da": "danish", "fi": "finnish", "hu": "hungarian", "ro": "romanian", "tr": "turkish", "ar": "arabic", "hi": "hindi", "ta": "tamil"}

LANGUAGES = tuple(sorted(_LISTS))


def for_language(name: str) -> list[str] | None:
    """The list of a language, by its English name or ISO code in any case; None if there is none."""
    key = name.strip().lower()
    words = _LISTS.get(CODES.get(key, key))
    return words.split() if words is not None else None
