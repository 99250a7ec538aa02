"""Word lists and tables of the media domain.

Fixed values: the entries below decide results and are the published ones, as they stand.
"""

from __future__ import annotations

BRANDS = tuple("""
toyota, honda, nissan, mazda, hyundai, kia, chevrolet, chevy, ford, dodge, jeep, ram, chrysler, buick, cadillac, gmc,
volkswagen, vw, audi, bmw, mercedes, mercedes-benz, mercedes benz, porsche, mini, opel, seat, peugeot, renault, citroën,
citroen, fiat, alfa romeo, alfa, ferrari, lamborghini, maserati, bentley, rolls-royce, rolls royce, aston martin, aston,
mclaren, jaguar, land rover, range rover, volvo, saab, subaru, suzuki, mitsubishi, lexus, acura, infiniti, tesla, rivian,
lucid, byd, mg, jac, chery, great wall, haval, geely
""".strip().replace("\n", " ").split(", "))  # fmt: skip

MODELS_OF = {
    "toyota": "camry, corolla, rav4, highlander, 4runner, tacoma, tundra, prius, bz4x, supra, sequoia, sienna, avanza, yaris, hilux, fortuner",
    "honda": "civic, accord, cr-v, crv, hr-v, hrv, pilot, odyssey, passport, fit, jazz, ridgeline",
    "nissan": "altima, sentra, versa, rogue, pathfinder, murano, titan, frontier, kicks, leaf, maxima, armada, qashqai",
    "hyundai": "ioniq, tucson, santa fe, elantra, sonata, accent, palisade, venue, creta, kona, santa cruz",
    "kia": "sorento, sportage, seltos, telluride, forte, stinger, k5, ev3, ev4, ev5, ev6, ev9",
    "ford": "f-150, f150, mustang, explorer, escape, edge, ranger, bronco, maverick, expedition, fusion, focus, lightning",
    "chevrolet": "silverado, tahoe, suburban, equinox, traverse, blazer, camaro, corvette, malibu, impala, trailblazer, onix, trax, tracker, trailseeker, cruze, sonic, spin, colorado",
    "cadillac": "escalade, lyriq, vistiq, celestiq, optiq, ct4, ct5, ct6, xt4, xt5, xt6",
    "buick": "enclave, encore, envision, regal",
    "gmc": "sierra, acadia, terrain, yukon, canyon",
    "tesla": "model s, model 3, model x, model y, cybertruck, cybercab, robotaxi, roadster",
    "volkswagen": "id.3, id.4, id.7, id buzz, id.buzz, taos, atlas, tiguan, jetta, passat, golf, polo, nivus, t-cross, tcross",
    "subaru": "outback, forester, crosstrek, impreza, ascent, legacy, brz, uncharted",
    "jeep": "wrangler, grand cherokee, gladiator, compass, renegade, cherokee, wagoneer, grand wagoneer",
    "byd": "atto, seal, dolphin, yuan, song, tang, han, destroyer",
    "bmw": "i4, i5, i7, ix1, ix3",
    "mazda": "cx-3, cx-30, cx-5, cx-50, cx-70, cx-9, cx-90, mx-5, mx-30",
    "mitsubishi": "outlander, l200, montero, eclipse cross",
}
#: Models that everyday words collide with: a mention does not imply the brand.
NO_INFERENCE = ("yuan", "song", "tang", "han", "destroyer", "eclipse cross")

CURIOSITY_HOOKS = tuple("no te imaginas, descubre, la verdad, secreto, increíble, increible, asombroso, revelación, revelacion, misterio, sorprendente, no lo creerás, no lo creeras, lo que no sabías, lo que no sabias".split(", "))
REVIEW_KEYWORDS = tuple("review, reseña, resena, prueba, test drive, testdrive, pov, análisis, analisis, opinión, opinion, revisión, revision".split(", "))
SUPERLATIVES = ("mejor", "peor", "mayor", "menor", "top")
NEGATIONS = ("no compres", "no compre", "nunca compres", "nunca compre", "jamás")
COMPARATIVES = (" vs ", " vs. ", "versus ", "comparado ", "comparativa")
COLLAB_KEYWORDS = tuple("saludo especial, colaboración, colaboracion, colab, colabo, featuring, ft., feat., en colaboración, en colaboracion".split(", "))

KEYWORDS = {
    "superlative": ("mejor", "mejores", "peor", "peores", "top", "mas"),
    "freshness": ("nuevo", "nueva", "nuevos", "nuevas", "lanzamiento", "estreno"),
    "powertrain": tuple("electrico, electrica, electricos, electricas, ev, bev, hibrido, hibrida, hibridos, hibridas, hybrid, phev, diesel, gasolina, turbo".split(", ")),
    "category": tuple("suv, sedan, crossover, coupe, hatchback, pickup, minivan, convertible, wagon, familiar".split(", ")),
    "review_format": REVIEW_KEYWORDS,
}

#: Words a corrector leaves alone, beyond brands, models and review words.
EXTRA_WORDS = tuple("""
mejor, mejores, peor, peores, nuevo, nueva, nuevos, nuevas, prueba, pruebas, review, reviews, análisis, opinión, revisión,
carro, carros, auto, autos, coche, coches, vehículo, vehículos, camioneta, camionetas, moto, motos, eléctrico, eléctrica,
eléctricos, eléctricas, híbrido, híbrida, híbridos, híbridas, suv, sedan, sedán, pickup, coupé, crossover, hatchback, vw, mg,
byd, jac, gm, ioniq, uncharted, trailseeker, idbuzz, idbuz, awd, 4wd, rwd, fwd, abs, tpms, cvt, dsg, pov, dueño, dueña
""".strip().replace("\n", " ").split(", "))  # fmt: skip
FORCED = {
    "cadillae": "cadillac", "cadilac": "cadillac", "hyundia": "hyundai", "hyunday": "hyundai", "toyoto": "toyota",
    "tayota": "toyota", "hbrida": "híbrida", "hbridas": "híbridas", "hbrido": "híbrido", "hbridos": "híbridos",
    "hbrda": "híbrida", "idbu2": "idbuzz", "idbuz": "idbuzz", "idbuzz": "id buzz", "electpicos": "eléctricos",
    "electrpcos": "eléctricos", "palsade": "palisade", "foresteer": "forester", "dodgi": "dodge", "fore5ter": "forester",
}
#: Terms near which the frequency corrector changes nothing, beyond brands, models and keywords.
GATE_WORDS = tuple("rav4, cr-v, crv, f-150, f150, id, buzz, idbuzz, review, test, drive, new, vs, versus, gasolina, gasolinas, diesel, electrico, electrica, electricos, electricas".split(", "))

#: Digits that a misread character of a year may stand for.
YEAR_READINGS = {str(d): str(d) for d in range(10)} | {
    "o": "0", "q": "0", "d": "0", "i": "1", "l": "1", "|": "1", "z": "2", "r": "2", "e": "3", "a": "4", "s": "5", "g": "69",
    "b": "68", "t": "7", "v": "026", "y": "71", "n": "0",
}
YEARS = (1970, 2030)

BRAND_ALIASES = {
    "mercedes": "mercedes", "mercedes benz": "mercedes", "mercedes-benz": "mercedes", "vw": "vw", "volkswagen": "vw",
    "alfa": "alfa romeo", "alfa romeo": "alfa romeo", "citroen": "citroen", "citroën": "citroen", "rolls royce": "rolls royce",
    "rolls-royce": "rolls royce", "chevrolet": "chevrolet", "chevy": "chevrolet", "aston": "aston martin", "aston martin": "aston martin",
}
MODEL_ALIASES = {"crv": "cr-v", "cr-v": "cr-v", "id buzz": "id buzz", "id.buzz": "id buzz"}
KEYWORD_ALIASES = {
    "opinión": "opinion", "opinion": "opinion", "revisión": "revision", "revision": "revision", "electrico": "electrico",
    "electricos": "electrico", "electrica": "electrico", "electricas": "electrico", "hibrido": "hibrido", "hibrida": "hibrido",
    "hibridos": "hibrido", "hibridas": "hibrido", "hybrid": "hibrido", "nuevo": "nuevo", "nuevos": "nuevo", "nueva": "nuevo",
    "nuevas": "nuevo", "mejor": "mejor", "mejores": "mejor", "peor": "peor", "peores": "peor",
}

MODELS = tuple(m for models in MODELS_OF.values() for m in models.split(", "))
MODEL_BRAND = {m: brand for brand, models in MODELS_OF.items() for m in models.split(", ") if m not in NO_INFERENCE}


def correction_words() -> tuple[str, ...]:
    """All words a corrector leaves alone, with the space-less form of those of several words."""
    words = {w.lower() for w in (*BRANDS, *MODELS, *REVIEW_KEYWORDS, *EXTRA_WORDS)}
    return tuple(sorted(words | {w.replace(" ", "") for w in words}))


def gate_words() -> tuple[str, ...]:
    return tuple(sorted({*BRANDS, *MODELS, *(w for words in KEYWORDS.values() for w in words), *GATE_WORDS}))
