"""Labelled lines with personal data, made by rule, to train and to measure the CRF.

A line is a template with values put in. Templates and values of the training lines
and of the held-out lines are apart: other wordings, other names, other alphabets.
"""

from __future__ import annotations

import random
import string

#: What the CRF labels beside the fixed patterns.
LEARNT = ("secret", "name", "birth", "national_id", "iban", "address")

#: Words that announce a value, by kind. Fixed lists.
CUES = {
    "secret": frozenset("password passwd passphrase pwd passwort contraseña secret token apikey key auth authorization bearer credential credentials pin".split()),
    "name": frozenset("name named mr mrs ms dr dear herr frau monsieur madame señor señora nom nombre heiße heisse appelle llamo".split()),
    "birth": frozenset("born dob birthday birthdate birth geboren geburtsdatum né née naissance nacido nacida nacimiento".split()),
    "national_id": frozenset("ssn passport nif dni nie insee steuernummer personalausweis licence license".split()),
    "iban": frozenset(["iban"]),
}
#: Words that make an address.
STREETS = frozenset("street avenue ave road rd lane drive boulevard blvd square strasse straße platz allee weg gasse rue chemin quai calle avenida paseo plaza".split())
#: Other words that tell: months, and what stands between a cue and its value.
MONTHS = frozenset("january february march april may june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split())
BETWEEN = frozenset("is was of no number nr num on the am le el de del ist est es date my in at".split())

_NAMES = "Anna Berg Carlos Diaz Emma Fischer Georg Hahn Ines Jansen Karl Lopez Marie Noel Oskar Perez Rosa Schmidt Tom Weber".split()
_OTHER_NAMES = "Alice Baker Bruno Costa Clara Dupont Felix Garnier Helen Iversen John Smith Laura Meyer Nina Ortega Paul Richter Sofia Torres".split()
_PLACES = "Main Oak High Park Church Mill Station Garden Bridge".split()
_OTHER_PLACES = "River Hill Castle Market Harbour Forest Lake".split()

_TRAIN = [
    "password={secret}", "the password={secret} was sent", "passwd: {secret}", "your pwd is {secret} and", 'token = "{secret}"', 'and a token = "{secret}" here', 'api_key: "{secret}"', "secret={secret}", "client secret: {secret}",
    "Authorization: Bearer {secret}", "auth token {secret} at the end", "passphrase = {secret}", "credentials: {secret}", "access key = {secret}", 'mot de passe password={secret} et token = "{secret}".', "Passwort: {secret}",
    '12345 token = "{secret}" some words. +1 (545) 555-9193', "password={secret} from 10.20.30.40, a@b.example.com (4111111111111111) + 3", "key: {secret} | one | two (three) - 42 + 7", "it is no pin: {secret}, 20 - 30 (40)",
    "My name is {name}, hello", "Dear {name}, thank you", "signed: Mr {name}", "I met Dr {name} there.", "Name: {name}", "mein Name ist {name} und", "Frau {name} kam", "je m'appelle {name} et", "Monsieur {name} est ici", "me llamo {name}.", "Nombre: {name}",
    "born {birth} in town", "Date of birth: {birth}", "DOB {birth}", "was born on {birth}.", "geboren am {birth} in", "née le {birth}", "nacido el {birth}",
    "SSN {ssn}", "her SSN is {ssn} now", "passport no {passport}", "Passport number: {passport}.", "DNI {dni}", "NIF: {dni}", "INSEE {insee}",
    "IBAN {iban}", "the IBAN: {iban}.", "pay to IBAN {iban} soon",
    "IBAN {iban}, {address}", "SSN {ssn}, {address}", 
    "I live at {address}.", "Address: {address}, please", "{address}", "sent to {address} in May",
    "name: {name}, born {birth}, SSN {ssn}", "Herr {name}, geboren {birth}, IBAN {iban}",
]
_HELD_OUT = [
    "db password is {secret} (change it)", "PIN: {secret}", "bearer {secret}", "set token={secret} then", "contraseña: {secret}",
    "Hi, the name is {name} by the way", "Mrs {name} called today", "Señora {name} vive aquí", "nom: {name}", "ich heiße {name}, und du",
    "birthday {birth}!", "date de naissance: {birth}", "Geburtsdatum {birth}.",
    "my ssn: {ssn}, ok", "licence no {passport}", "DNI: {dni} es",
    "use IBAN {iban}, thanks", "IBAN = {iban}", "deliver it to {address} today", "our office, {address}, is open", "My name is {name}, born {birth}, SSN {ssn}, IBAN {iban}, {address}",
]

#: Lines without personal data: cues that announce nothing, and numbers, codes and capitals that nothing announces.
PLAIN = [
    "the key is under the mat", "a password must be long, and the token was lost.", "she has the key to the secret garden = her joy", "token of thanks: a small gift", "the pin fell on the floor in 1998",
    "password reset was asked for on 2021-03-04", "key = value, name = other", "the name of the river is old", "the name was known to all of them", "in the name of the law", "she was born in a small town", "a star is born, they said",
    "the birth of an idea in 1999", "your passport, please", "a licence to fly is hard to get", "Released under the MIT License.", "Licensed under the Apache License, Version 2.0", "the street was empty at night", "on the road again, 12 years later",
    "he went down the lane and over the square", "the drive took 3 hours", "St of the art", "call +1 (555) 555-0100 before 10.30", "the card 4111111111111111 and host 10.20.30.40", "mail a.person.12@mail3.example.com or b@c.org today",
    "it rained in 2004, 2005 and 2006.", "section 12b of part A4, page 117", "the B52 and the A380 flew over r2d2", "order 66431 was sent; invoice 2023x0017 is open", "one | two | three | four.", "what*** is### this$$$ about&&& here%%%",
    "LOUD!! WORDS!! AGAIN!! AND!! AGAIN!!", 'He said: "we will see", and left.', "die Straße und der Weg, über den Fluss", "un été à la mer; où est le chat ?", "el niño y la niña: una canción.", "la calle es larga, la plaza es grande", "der Weg ist das Ziel",
    "version 1.2.3 of lib64 runs on x86", "ratio = 3, size: 4, weight = 12", "see https://www.example.com/en/12?page=2#top", "sha of nothing", "Dear reader, this is the end", "no name, no number, no date", "Frau und Mann, alt und jung", "May was warm, June was wet",
    "the author of the book is known", "auth is hard", "the bearer of bad news", "credentials matter", "Mr and Mrs were late", "Mrs and Mr", "a birth in 12 hours", "birthday cards for 20 children", "the IBAN is missing", "her SSN is private",
]
_HELD_OUT_PLAIN = [
    "a secret is kept by two", "the token system = fair", "what is in a name", "my name is known here", "dear all, see you at 5", "he was born to run", "on the street where you live", "the key of C major, 440 Hz",
    "the pin code is lost", "a birthday party for 12 people", "the rue was wet", "Mr and Mrs came late", "Version 3 of the license text", "avenue of trees, 200 of them", "Le nom de la rose", "bearer shares are rare", "Passport control is slow", "no password is needed",
]


def _secret(r: random.Random, other: bool) -> str:
    alphabet = r.choice(["0123456789abcdef", string.ascii_letters + string.digits] if not other else [string.ascii_lowercase + string.digits, "0123456789ABCDEF", string.ascii_letters + string.digits])
    while True:
        out = "".join(r.choices(alphabet, k=r.choice([8, 10, 12, 16, 18, 20, 24, 32, 40, 64])))
        if sum(c.isdigit() for c in out) > 1 and any(c.isalpha() for c in out):
            return out


def _date(r: random.Random) -> str:
    d, m, y = r.randint(1, 28), r.randint(1, 12), r.randint(1930, 2010)
    return r.choice([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m}/{d}/{y}", f"{d} {r.choice(sorted(MONTHS)).capitalize()} {y}"])


def _address(r: random.Random, places: list[str]) -> str:
    n, place = r.randint(1, 199), r.choice(places)
    return r.choice([f"{n} {place} {r.choice(['Street', 'Avenue', 'Road', 'Lane'])}", f"{n}{r.choice('ab')} {place} {r.choice(places)} {r.choice(['Street', 'Drive'])}", f"{n} rue {place}", f"{place} Straße {n}", f"Calle {place} {n}"])


def _values(r: random.Random, other: bool) -> dict[str, tuple[str, str]]:
    names, places = (_OTHER_NAMES, _OTHER_PLACES) if other else (_NAMES, _PLACES)
    digits = lambda n: "".join(r.choices(string.digits, k=n))
    iban = r.choice(["DE", "FR", "ES", "NL"]) + digits(2) + " " + " ".join(digits(4) for _ in range(r.randint(3, 5)))
    return {
        "secret": ("secret", _secret(r, other)), "name": ("name", " ".join(r.sample(names, r.randint(1, 3)))), "birth": ("birth", _date(r)), "ssn": ("national_id", f"{digits(3)}-{digits(2)}-{digits(4)}"),
        "passport": ("national_id", r.choice("CLXPAB") + digits(8)), "dni": ("national_id", digits(8) + r.choice("TRWAGM")), "insee": ("national_id", f"{digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(3)} {digits(3)}"),
        "iban": ("iban", iban if r.random() < 0.6 else iban.replace(" ", "")), "address": ("address", _address(r, places)),
    }


def _filled(template: str, values: dict[str, tuple[str, str]]) -> tuple[str, list[tuple[int, str, int]]]:
    """(line, spans (start, kind, end)) of a template."""
    out, spans, at = "", [], 0
    for text, field, _, _ in string.Formatter().parse(template):
        out += text
        if field:
            kind, value = values[field]
            spans.append((len(out), kind, len(out) + len(value)))
            out += value
    return out, spans


def labelled_lines(held_out: bool = False, each: int = 12) -> list[tuple[str, list[tuple[int, str, int]]]]:
    """Lines and their spans: ``each`` of every template, and the plain ones."""
    r = random.Random(2 if held_out else 1)
    lines = [_filled(t, _values(r, held_out)) for t in (_HELD_OUT if held_out else _TRAIN) for _ in range(each)]
    plain = _HELD_OUT_PLAIN if held_out else PLAIN
    lines += [(x, []) for x in plain for _ in range(1 if held_out else 4)]
    return lines
