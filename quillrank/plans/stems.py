"""Words and their stems by the published algorithms, as "word stem word stem ..." for each language."""

PAIRS = {
    "english": "running run caresses caress flies fli dying die happy happi national nation generously generous hopping hop hoping hope skies sky relational relat adjustable adjust sensational sensat by by say say cry cri luxuriated luxuri knightly knight knackeries knackeri",
    "german": "aufeinanderfolge aufeinanderfolg kategorischen kategor",
    "swedish": "jaktkarlarne jaktkarl",
    "norwegian": "havnedistriktene havnedistrikt",
    "french": "continu continu continua continu continuait continu continuant continu continuation continu continué continu continuel continuel continuelle continuel continuellement continuel continuer continu main main maintenait mainten maintenant mainten maintenue maintenu maintien maintien majestueuse majestu majestueusement majestu majestueux majestu majesté majest majeure majeur majorité major malade malad maladie malad malheureusement malheur malheureux malheur",
    "spanish": "chicas chic chico chic chicharrones chicharron cheques chequ toros tor torneado torn torneos torne torneo torne torres torr torso tors tortura tortur torturado tortur torturas tortur",
    "italian": "abbandonata abbandon abbandonate abbandon abbandonati abbandon abbandonato abbandon abbandono abband abate abat pronto pront pronuncia pronunc pronunciamento pronunc propaganda propagand propagare propag propizio propiz proprietà propriet",
    "portuguese": "boa boa boas boas bola bol bolsa bols bolsas bols quilométricas quilométr quilos quil quilômetro quilômetr quebra quebr quebrada quebr quebradas quebr quebrar quebr quebrou quebr queda qued quedas qued queijo queij queijos queij",
    "dutch": "lichaam licham lichamen licham lichamelijk licham lichamelijke licham opgingen opging opglimpende opglimp",
    "russian": "вавиловка вавиловк вагнера вагнер вагон вагон вагона вагон вагоном вагон важная важн важнее важн важнейшие важн важнейшими важн важничал важнича важно важн важность важност падает пада падать пада падение паден палаты палат",
    "finnish": "edeltäjien edeltäj innostukseen innostuks taloissa talo autot auto kaupungissa kaupung",
    "hungarian": "babakocsi babakocs babakocsijáért babakocs házban ház",
    "romanian": "abruptă abrupt absent absent absenta absent absente absent absolvenţii absolvenţ accidentele accident",
}


def rows() -> list[tuple[str, str, str]]:
    """(language, word, stem)."""
    return [(k, w, s) for k, v in PAIRS.items() for w, s in zip(v.split()[::2], v.split()[1::2])]
