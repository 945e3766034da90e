"""Word lists of this repository: common words by language, written down for it from general knowledge.

Fixed values in the sense that results depend on them; a list is a parameter wherever it is used.
"""

from __future__ import annotations

#: Marker words by which a text's language is told, in the order in which ties are decided.
MARKERS = {
    "es": "el la los las de del que en y un una por con no se su para es al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre",
    "en": "the of and to in is that it was for on are with as his they be at one have this from or had by but some what there we can out other were all",
    "fr": "le la les de des du et en un une que qui dans pour pas sur est avec ce il sont plus par au ne se cette ou mais nous comme aux ses été",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei",
    "it": "il lo la gli le di che e un una per con non si del della in da dei sono al come più ma ha anche nel alla delle questo",
    "pt": "o a os as de do da que e em um uma para com não se na no por mais dos como mas foi ao ele das tem seu sua ou quando",
}
#: Words that carry no topic, by language: markers and further common ones.
STOP = {
    "es": MARKERS["es"] + " a e u ni o lo me mi mis tu tus te ti nos os les nosotros ella ellos ellas él yo tú usted ustedes cual cuales quien quienes cuyo donde cuando mientras aunque porque pues desde hasta hacia según durante mediante "
    "contra tras ante bajo cada todo toda todos todas otro otra otros otras mismo misma mucho mucha muchos poco poca tan tanto algún alguna algunos ningún ninguna nada algo aquí allí ahí así también tampoco no ser es son era fue eran fueron sea "
    "he has ha hemos han había haber estar está están estaba tiene tienen tenía hay solo sólo esto esta estos estas eso esa esos esas aquel aquella del al una unas unos",
    "en": MARKERS["en"] + " a i me my we us our you your he him she her its them those these which who whom whose how when where why while than then so if because about into over under between through during before after above below up down off "
    "again further once here both each few more most such no nor only own same too very just also may might must should could would will shall do does did done doing has having am been being were any",
    "fr": MARKERS["fr"] + " a au à y on nous vous ils elles elle lui leur leurs mon ma mes ton ta tes son sa notre votre quel quelle quels dont où si ni car donc or puis entre vers chez sous sans avant après pendant depuis cela ça ceci celui celle ceux "
    "tout tous toute toutes autre autres même mêmes très peu trop aussi alors être était étaient sera ai as avons avez ont avait avoir fait faire peut",
    "de": MARKERS["de"] + " ich du er wir ihr mich mir dich dir ihn ihm uns euch mein dein sein unser euer eines einem einen einer kein keine doch noch nur schon sehr so wenn weil ob oder aber denn dann damit durch gegen ohne um bis seit über unter vor "
    "nach zwischen hinter neben war waren bin bist sind seid habe haben hatte hatten wurde wurden kann können muss soll will dieser diese dieses jener welche was wer wo wie warum man mehr am zum zur vom beim",
}
#: Words that measure, date or price, and so say nothing of a topic on their own.
MEASURES = (
    "km m cm mm kg g mg l ml w kw kwh v hz kb mb gb tb h min s euro euros eur dólar dólares dollar dollars usd pound pounds peso pesos "
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre january february march april may june july august september october november december "
    "janvier février mars avril mai juin juillet août septembre octobre novembre décembre januar februar märz juli august oktober dezember"
)
#: Suffixes of Spanish verb forms, and English forms that open or close a phrase as verbs do.
ES_VERB = r"(?:ando|iendo|aron|ieron|aba|aban|aría|arían|ería|erían|aremos|eremos|iremos|aste|iste)$"
EN_VERB = "is are was were be been being has have had do does did can could will would should may might must get gets got make makes made use uses used go goes went"
#: Anchor texts that say nothing about their target, folded.
GENERIC = (
    "aqui", "aca", "click", "clic", "haz clic", "haz click", "pincha aqui", "pulsa aqui", "este articulo", "este enlace", "esta pagina", "mas informacion", "mas info", "leer mas", "ver mas", "saber mas", "enlace", "link", "web", "pagina", "articulo",
    "here", "click here", "read more", "more", "more info", "this article", "this page", "this link", "learn more", "article", "page", "website",
)
#: Words of an address's last part, between hyphens, that mark pages that aren't content: legal notes, contact, carts, accounts.
UNLIKE = ("aviso-legal", "legal", "privacidad", "privacy", "cookies?", "terminos", "condiciones", "terms", "conditions", "contacto", "contact", "carrito", "cart", "checkout", "mi-cuenta", "my-account", "login", "acceso", "registro", "register")
NON_CONTENT = rf"(?:^|/)(?:[^/]*-)?(?:{'|'.join(UNLIKE)})(?:-[^/]*)?/?$"
