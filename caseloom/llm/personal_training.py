"""Labelled sentences for the personal-information field, made from frames and fillers.

``labelled(people, seed, n, frames)`` yields (text, address, gold spans).  Frames are
plain sentences of several languages with places for entities and for things that look
like them: order numbers, dates, versions, firms, rooms, headings.  Nothing here is taken
from any corpus; names are those of the directory rows given and of the short lists below.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

GIVEN = (
    "James Mary Robert Patricia John Jennifer Michael Linda David Elizabeth William Barbara Richard Susan Sarah Karen Emma Olivia Liam Noah Priya Anjali Ravi Sunita Wei Li Mei Hiroshi Yuki Kenji Minh Van Thi Ahmed Fatima Omar Layla "
    "Mohammed Aisha Yusuf Amina Kwame Ngozi Chinedu Juan María José Carmen Luis Ana Carlos Lucía Javier Sofía Pedro João Inês Tiago Beatriz Miguel Catarina Jean Pierre Marie Claire Luc Élodie François Hélène Camille Antoine Hans Jürgen Ursula "
    "Klaus Heike Günther Sabine Lukas Anke Giovanni Giulia Marco Chiara Luca Francesca Piotr Agnieszka Krzysztof Małgorzata Jan Tomáš Eva Lars Ingrid Björn Astrid Søren Mette Иван Анна Сергей Елена Ольга Дмитрий Наталья Алексей"
).split()
FAMILY = (
    "Smith Johnson Williams Brown Jones Miller Davis Wilson Taylor Clark Lewis Walker Hall Young Wright Scott Green Baker Carter Mitchell O'Connor O'Neill McDonald MacLeod Raghunathan Sharma Patel Iyer Chatterjee Nguyen Tran Pham Wang Zhang Chen Tanaka Suzuki "
    "Yamamoto Watanabe Kim Park Hassan Ibrahim Abdullah Rahman Okafor Mensah Adeyemi García López Martínez Fernández Rodríguez Sánchez Ruiz Silva Santos Pereira Oliveira Costa Dubois Lefèvre Moreau Girard Rousseau Fontaine Müller Schmidt Schneider "
    "Fischer Weber Krüger Hoffmann Schäfer Rossi Ferrari Bianchi Esposito Colombo Kowalski Nowak Wiśniewski Novák Dvořák Svensson Lindqvist Hansen Jørgensen Berg Иванов Петрова Смирнов Кузнецова Соколов Васильева"
).split()
PARTICLES = ("de", "del", "de la", "van", "van der", "von", "da", "dos", "di", "bin", "el", "la")

_TYPES_FRONT = ("Street", "Road", "Avenue", "Lane", "Drive", "Court", "Square", "Place", "Boulevard", "Close", "Terrace", "Way", "Crescent", "St", "Rd", "Ave", "Blvd", "Ln")
_EN = ("Oak", "Maple", "Church", "Station", "High", "Mill", "Park", "Queen", "Victoria", "King", "Elm", "Washington", "North Hill", "Green", "South Bridge", "Cedar", "Lake", "West End", "Market", "Rose", "Granary", "Old Quarry")
_FR = ("rue", "avenue", "boulevard", "place", "impasse", "chemin", "allée", "quai", "route", "cours", "passage", "RUE", "av.", "bd")
_FR_OF = ("de la République", "des Lilas", "du Moulin", "Victor Hugo", "de l’Église", "des Écoles", "du Général Leclerc", "Pasteur", "de la Gare", "des Champs", "du Vieux Pont", "de Paris", "Saint-Michel", "DES ROSES", "DU PORT")
_DE_HEAD = ("Garten", "Haupt", "Schul", "Bahnhof", "Berg", "Kirch", "Linden", "Birken", "Goethe", "Wald", "Mozart", "Bäcker", "Rosen", "Wiesen")
_DE_TAIL = ("straße", "strasse", "str.", "gasse", "weg", "allee", "platz", "ring", "damm", "ufer", "steig")
_ES = ("Calle", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Rua", "Travessa", "Praça", "Via", "Viale", "Largo", "C/", "Avda.")
_ES_OF = ("Mayor", "de Alcalá", "del Sol", "de la Paz", "San Juan", "de los Olmos", "das Flores", "da Liberdade", "de Abril", "Garibaldi", "Roma", "del Carmen", "de las Huertas", "do Carmo", "Real", "del Pozo Nuevo")
_TOWN = ("Springfield", "Lyon", "Bremen", "Porto", "Madrid", "Leeds", "Austin", "Torino")


def digits(r: random.Random, shape: str) -> str:
    """9 any digit, 8 a digit from 1 on."""
    return "".join(str(r.randint(0, 9)) if c == "9" else str(r.randint(1, 9)) if c == "8" else c for c in shape)


_PHONES = (
    "(289) 555-9999", "289-555-9999", "289.555.9999", "+1 289-555-9999", "1-289-555-9999", "+1 (289) 555-9999", "+12895559999", "289 555 9999", "020 7999 9999", "07999 999 999", "07999 999999", "+44 7999 999999", "+44 20 7999 9999", "0121 999 9999",
    "08 89 99 99 99", "08.89.99.99.99", "06 99 99 99 99", "+33 8 89 99 99 99", "+33 (0)8 89 99 99 99", "0033889999999", "+33899999999", "0889999999", "+49 30 9999999", "+49 30 99999 999", "(0221) 9999 999", "0221/999999", "030/99999-999", "0171 9999999", "0049 89 999999",
    "899 99 99 99", "+34 899 99 99 99", "(+34) 899 99 99 99", "899-999-999", "0034899999999", "+351 91 999 9999", "219 999 999", "+39 06 9999 9999", "06 9999 9999", "339 999 9999", "+7 (495) 999-99-99", "8 (812) 999-99-99", "+48 22 999 99 99", "+91 98999 99999", "+86 138 9999 9999",
    "+81 3-9999-9999", "03-9999-9999", "+41 44 999 99 99", "+32 2 999 99 99", "+31 20 999 9999", "+46 8 999 999 99", "0800 999 999", "1-800-555-9999", "+61 2 9999 9999", "+55 11 99999-9999", "(11) 99999-9999", "0999 999999", "899 999 999",
)
def _phone(r: random.Random) -> str:
    """A phone number of a country's usual form, or its digits grouped in another way."""
    got = digits(r, r.choice(_PHONES))
    if got[0] == "+" and r.random() < 0.3:
        got = "00" + got[1:]
    if got[:1] in "+0" and r.random() < 0.3:
        head, rest = re.match(r"(\+\d\d?|00\d\d|0)(.*)", got).groups()
        rest = re.sub(r"\D", "", rest)
        sep, cuts = r.choice("   -./"), []
        while rest:
            n = r.randint(2, 5) if len(rest) > 5 else len(rest)
            cuts.append(rest[:n])
            rest = rest[n:]
        got = head + (sep if len(head) > 2 else "") + sep.join(cuts)
    return got


_PHONE_CUES = (
    "tel", "Tel.", "tel.:", "Tel:", "phone", "Phone:", "telephone", "mobile", "my mobile", "Mobile:", "cell", "Cell:", "call", "Call", "call me on", "Call me at", "ring", "ring me on", "rung at", "be reached at", "reach me at", "text me on", "text", "dial", "fax", "Fax:", "WhatsApp", "hotline", "direct line", "my number is", "contact number",
    "Tél.", "Tél. :", "téléphone", "mon portable est le", "mon numéro :", "portable :", "appelez le", "Appelez-moi au", "rappelez-moi au", "joignable au", "Telefon", "Telefon:", "Handy", "Handy:", "Mobil:", "rufen Sie", "erreichen Sie mich unter", "unter der Nummer", "Rückruf unter", "teléfono", "Teléfono:", "Tfno.", "móvil", "mi móvil es", "llame al", "Llámeme al", "telefone", "Telefone:",
    "telemóvel", "ligue para", "Ligue", "telefono", "cellulare", "chiami il", "тел.", "телефон", "звоните", "мобильный:",
)
_ID_CUES = (
    "SSN", "SSN:", "social security number", "my SSN is", "The SSN is", "Social Security no.", "National Insurance number", "National Insurance", "insurance number", "NI number", "NINO:", "national id", "National ID:", "identity number", "ID number", "ID no.", "identity card", "identity card no.", "tax id", "tax number", "TIN", "taxpayer number", "passport no.", "identification number", "NHS number",
    "numéro de sécurité sociale :", "n° de sécurité sociale", "NIR", "mon NIR est le", "numéro fiscal", "carte d’identité", "Steuer-ID", "meine Steuer-ID ist", "Steueridentifikationsnummer", "Identifikationsnummer", "Steuernummer", "Sozialversicherungsnummer", "Ausweisnummer", "Personalausweis", "Rentenversicherungsnummer", "DNI", "mi DNI es", "DNI/NIE:", "NIE", "NIF", "documento de identidad", "número de la seguridad social",
    "CPF", "contribuinte", "número de contribuinte", "cartão de cidadão", "NISS", "codice fiscale", "PESEL", "BSN", "personnummer", "Aadhaar", "СНИЛС", "ИНН", "паспорт",
)
_ID_FRAMES = ("{c} {x}", "{c}: {x}", "{c} {x}.", "The {c} on record is {x}.", "{c} {x}, please keep it safe.", "{c} = {x}", "as {c} use {x} for the form", "({c} {x})", "{c} is {x}.", "{c} {x} is mine.", "{c} est {x}.", "{c} ist {x}.", "{c} es {x}.", "For the office take {x} as {c}.")
_PHONE_FRAMES = ("{c} {x}", "{c} {x}.", "{c}: {x}", "{c} {x} before ten.", "{c} {x}, thanks.", "Please {c} {x} today.", "You can {c} {x}.", "{c} {x} ext. 12", "{c} {x} an.", "{c} {x}, merci.", "{c} {x} por la tarde.", "({c} {x})", "{c} {x}; ask for the desk.", "({x})", "{b} ({x})", "{b} {x}", "{x}", "{n}, {x}", "{n}\n{x}", "{c} ({x})")
_OTHER = (
    "999-9999999-9999999", "99-99-9999-99", "9999/9999/99", "9999-99-99", "2099-09-19", "19.09.2099", "19/09/2099", "192.0.2.99", "198.51.100.99", "10.99.9.199", "9.99.9999", "99.999.9999", "v9.9.9", "9999 999", "99999999", "999999999999", "9999999999", "1Z999AA99999999999", "978-9-99-999999-9", "9999 9999 9999 9999", "99,999.99", "9.999.999", "99 999 999", "999-99-A", "9999-99-B", "A9-99999", "AB-99999", "AB-9999-999-9999",
    "PL99 9999 9999 9999 9999 9999 9999", "DE99 9999 9999 9999 9999 99", "0x9f99a", "19:99:99", "2099/9999/99", "999 999", "99999", "9999999", "99-999", "99999-999", "999/99999-9",
)
_OTHER_CUES = (
    "Order no.", "Order", "order number", "Invoice", "Invoice no.", "invoice INV-", "Ticket", "Ticket #", "Case", "Case no.", "case file", "Ref.", "reference", "our reference", "Version", "version", "Build", "Release", "Article", "Art. no.", "item", "Part no.", "Serial no.", "serial number", "tracking number", "Parcel", "shipment", "IBAN", "account", "Account no.", "BIC", "ISBN", "the server", "the relay was", "host", "IP address", "from", "on", "dated", "booked on", "since",
    "total", "totals", "amount", "sum of", "price", "copies", "units", "counter shows", "reading of", "weight", "queue length", "batch", "lot", "hash", "checksum", "starts with", "the code is", "PIN", "room", "page", "line", "port", "Bestellnummer", "Rechnung", "Rechnung Nr.", "Vorgang", "Artikel", "Kundennummer", "Lieferschein", "Sendung", "commande", "facture n°", "dossier", "colis", "référence", "pedido", "factura", "expediente", "referencia", "encomenda", "fatura", "ordine", "fattura", "заказ", "счёт №",
)
_OTHER_FRAMES = ("{c} {x}", "{c} {x}.", "{c}: {x}", "{c} {x} is open.", "{c} {x} left the depot.", "The {c} {x} was noted.", "{c} {x} was installed.", "We saw {c} {x} units today.", "{c} {x} and later {y}.", "{c} {x} weighs 12 kg.", "See {c} {x} for more.", "Quote {x} with your answer.", "thanks for {x} / {y}.", "({x})", "{x}: closed", "as in {x} above", "{x}", "{c} {x} est ouverte.", "{c} {x} ist offen.", "{c} {x} llegó ayer.", "It reached {x} entries.", "{c} {x}, {y} and {x}", "{x} of {y} done", "The {c} says {x} now.")
_NAME_FRAMES = (
    "{n} called this morning.", "I met {n} yesterday.", "Please ask {n} for the key.", "ask {n} about it.", "As told by {n}, all is done.", "With kind regards,\n{n}", "Best wishes,\n{n}\nHead of Sales", "Thanks,\n{n}", "Yours,<br>{n}</p>", "Dear {n},", "My name is {n}.", "this is {n} speaking", "Dr {n} will sign.", "Mr. {n} has left.", "Mrs {n} agreed.", "Ms. {n} said so.", "Prof. {n} wrote:",
    "{n} wrote on Monday:", "From: {n}", "signed by {n}", "the file of {n} was closed", "between {n} and the firm", "The door was opened by {n} at noon.", "{n} brings the papers.", "{n} and two others came.", "approved by {n}.", "On behalf of {n}", "cc {n}", "{n}, the auditor, wrote.", "{n} (sales)", "contact {n} for help", "for {n} only", "to {n}:",
    "Ich heiße {n}.", "mein Name ist {n}", "Mein Name ist {n} und ich schreibe heute.", "My name is {n} and I write today.", "my name is {n}", "Mi nombre es {n}.", "Mon nom est {n}.", "Chamo-me {n}.", "Mi chiamo {n}.", "this is {n}.",
    "Je suis {n}.", "Je m’appelle {n}.", "Mme {n} est absente.", "M. {n} a appelé.", "Cordialement,\n{n}", "Voir {n} pour la clé.", "avec {n} hier", "{n} viendra demain.", "de la part de {n}", "Ich bin {n}.", "Mein Name ist {n}.", "Herr {n} kommt später.", "Frau {n} ist krank.", "Mit freundlichen Grüßen\n{n}", "Viele Grüße,\n{n}", "Wie mit {n} vereinbart, gilt das.", "{n} prüft das morgen.", "von {n} am Montag",
    "Soy {n}.", "Me llamo {n}.", "Sr. {n} no está.", "La Sra. {n} firmó.", "Saludos,\n{n}", "Atentamente,\n{n}", "con {n} ayer", "{n} llamó por la tarde.", "Pregunte por {n}.", "O meu nome é {n}.", "Cumprimentos,\n{n}", "com {n} ontem", "O Sr. {n} ligou.", "Cordiali saluti,\n{n}", "Sig. {n} ha chiamato.", "Меня зовут {n}.", "С уважением,\n{n}", "{n} позвонил вчера.", "{n}\n{phone}", "{n}\nTel. {phone}", "Regards,\n{n}\n{mail}",
)
#: Runs of capital words that name no person.
_NO_NAMES = (
    "Accounts Payable", "Human Resources", "Customer Care", "Technical Support", "Help Desk", "Sales Department", "Board Room", "Conference Room Birch", "Room Elm Hall", "Team Orange", "Team Silver Arrow", "Project Sunrise", "Project Deep Water", "Project Spring Tide", "Maple Street Capital", "Harbor Lane Partners", "Northwind Traders", "Blue Ocean Logistics", "Summit Freight", "Summit Billing",
    "Riverside Metrics", "Acme Holdings", "Global Parcel Service", "Security Team", "Weekly Newsletter", "Parcel Alerts", "Billing Desk", "Service Centre", "Head Office", "New York", "San Francisco", "United Kingdom", "Buenos Aires", "Hong Kong", "Good Morning", "Dear Customer", "Dear Sir", "Kind Regards", "Best Regards", "Annual Report", "Terms And Conditions", "Privacy Policy", "Last Monday", "Next Friday", "Until Tuesday", "Since Sunday",
    "Madame, Monsieur", "Service Client", "Pièce Jointe", "Bonjour Madame", "Sécurité Sociale", "Conseil Général", "Sehr geehrte Damen und Herren", "Die Lieferung", "Der Vertrag", "Das Angebot", "Unser Büro", "Ihr Kundenservice", "Guten Morgen", "Guten Abend", "Viele Grüße", "Beste Grüße", "Für Fragen", "Die Rechnung", "Die Abteilung Einkauf", "Im Lager", "Auf Anfrage", "Ohne Termin", "Meine Anschrift", "Schreiben Sie", "Rufen Sie",
    "Estimado Cliente", "Buenos Días", "Atención Al Cliente", "Mi Cuenta", "El Departamento", "Prezado Cliente", "Boa Tarde", "A Fatura", "Gentile Cliente", "Buongiorno", "Invoice Copy", "Order Number", "Case Number", "Meeting Room Cedar Court", "Oak Avenue Partners", "Willow Court", "Garden Terrace", "Market Square", "Windows Server", "Visual Studio", "Mail Delivery System", "Product Manager", "Chief Executive", "Purchase Order",
    "Data Protection Officer", "Quality Control", "Public Affairs", "Legal Counsel", "Operations Centre", "Night Shift", "Supplier Relations", "Investor Relations", "Guest Services", "Accounts Office", "THE OFFICE IS CLOSED TODAY", "PLEASE REPLY BY NOON AND KEEP A COPY", "LA OFICINA ESTÁ CERRADA", "LE BUREAU EST FERMÉ CE JOUR", "DAS BÜRO IST HEUTE GESCHLOSSEN", "A LOJA ESTÁ FECHADA HOJE", "NICHT ANTWORTEN", "DO NOT REPLY", "ACTION REQUIRED", "PRAZO FINAL",
)
_NO_NAME_FRAMES = ("Tomorrow, {b}", "Later, {b} was sent.", "Heute, {b} am Abend", "Depois, {b}", "Ensuite, {b}", "before the Holidays, {b} will open", "{b} sent the file.", "{b}", "Contact {b} today.", "{b}\n", "{b} is booked for noon.", "the notes of {b} are here", "Thanks,\n{b}", "from {b} we got it", "{b}, hello", "{b} opens at nine.", "{b} Please see below.", "with {b} and others", "{b}: open", "{b} started in May.", "welcome to {b}.", "Regards\n{b}\nThe office", "{b} The form is here.", "{b} {n} signed.", "{n}\n{b}", "{b}\n{n}")
_STREET_FRAMES = ("Please send it to {s}.", "I live at {s}.", "My address is {s}, {town}.", "{s}, {town}", "Address: {s}", "Deliver to {s} before noon.", "the house at {s} is sold", "Returns to {s} from now on.", "{s} is my home", "{s}", "J’habite {s}.", "Adresse : {s}", "Livraison au {s}.", "Ich wohne {s}.", "Anschrift: {s}", "Lieferung an {s}, 28195 {town}", "{s} ist hier", "Vivo en {s}.", "Entregar en {s}.", "Dirección: {s}", "Moro na {s}.", "Abito in {s}.", "Flat 3, {s}", "Unit 7, {s}, {town}")
_NO_STREET_FRAMES = ("We got {k} copies of the quote.", "{k} of the boxes arrived in place.", "Meeting in Elm Court at {k}.", "page {k} of the road map", "the square root of {k}", "It took {k} days on the way.", "Willow Court {k}:30", "Put item {k} in place of it", "a list of {k} ways", "The Court sat until {k} that day.", "Tennis Court open at {k}", "on the Road for {k} days", "Market Square at {k}:15", "der Weg war {k} km lang", "Platz {k} ist frei", "la place est libre à {k} heures", "la via è lunga {k} km", "la plaza tiene {k} bancos", "sent via mail {k} times", "a close of {k} points", "Row {k} of the table", "Place {k} in the race", "After {k} drive on to the next", "at {k} close the door", "Chapter {k} The Long Road", "{k} % of the way", "In {k} Minuten am Platz", "room {k} at the end of the street", "la place {k} est libre", "en la calle hay {k} coches", "der Weg ist {k} km lang")
_MAIL_FRAMES = ("{m}, {m}", "mail {m}", "{m} or {m}", "Write to {m} for more.", "{m}", "My address is {m}, please use it.", "cc: {m}", "<{m}>", "(mailto:{m})", "Contact ({m}) now.", "&lt;{m}&gt;", "Écrivez à {m}.", "Schreiben Sie an {m}.", "Escriba a {m}, gracias.", "Reply to {m} today", "Joindre {m} ce soir", "Meine Adresse lautet {m}.", "Copia para {m}", "{m} is on leave")
_NO_MAIL_FRAMES = ("{m}, {m}", "mail {m}", "{m} or {m}", "follow @our_shop on the web", "meet at 5 @ the cafe", "https://user@host.example/path", "see ftp://anon@files.example/pub", "two @ 3.50 each", "ask @team.leads for help", "at the desk, dot the line", "@everyone hello", "price at noon dot com boom is over")
_ADDRESS_FRAMES = ("{n} <{m}>", '"{n}" <{m}>', "'{n}' <{m}>", "{n} ({m})", "{m} ({n})", "{m}", "<{m}>", "{b} <{m}>", '"{b}" <{m}>', "{m} ({b})", "{b}", "{phone}@sms.example", "{n} {phone} <{m}>", "{b} ({phone}) <{m}>", "{b}: {m}", "{n}", "{b} ({phone})", "{n} ({phone}) <{m}>", "{b} ({phone}) <{m}>", "Newsletter <{m}>", "Info <{m}>", "{b} {phone} <{m}>", "<{phone}@gate.example>", "noreply <{m}>", "Postmaster <{m}>")


def _id(r: random.Random) -> str:
    kind = r.randrange(15)
    d = lambda shape: digits(r, shape)
    if kind < 3:
        sep = r.choice("- . -")
        return f"{d('899')}{sep}{d('99')}{sep}{d('9999')}"
    if kind < 5:
        a, b = r.choice("ABCEGHJKLMNPRSTWXYZ"), r.choice("ABCEGHJKLMNPRSTWXYZ")
        sep = r.choice(("", " "))
        return sep.join((a + b, d("99"), d("99"), d("99"), r.choice("ABCD")))
    if kind < 7:
        core = int(r.choice("12") + d("99") + f"{r.randint(1, 12):02d}" + d("99999999"))
        full = f"{core}{97 - core % 97:02d}"
        return full if r.random() < 0.4 else " ".join((full[0], full[1:3], full[3:5], full[5:7], full[7:10], full[10:13], full[13:]))
    if kind < 9:
        base, p = d(r.choice(("8999999999", "9999999999", "0099999999"))), 10
        for c in base:
            p = ((int(c) + p) % 10 or 10) * 2 % 11
        full = base + str((11 - p) % 10)
        return full if r.random() < 0.4 else " ".join((full[:2], full[2:5], full[5:8], full[8:]))
    if kind < 11:
        n = r.randint(0, 99_999_999)
        letter = "TRWAGMYFPDXBNJZSQVHLCKE"[n % 23]
        num = f"{n:08d}"
        form = r.choice(("{0}{1}", "{0}-{1}", "{0} {1}", "dots"))
        return f"{num[:2]}.{num[2:5]}.{num[5:]}-{letter}" if form == "dots" else form.format(num, letter if r.random() < 0.7 else letter.lower())
    if kind == 11:
        first, n = r.randrange(3), r.randint(0, 9_999_999)
        return f"{'XYZ'[first]}{r.choice(('', '-'))}{n:07d}{r.choice(('', '-'))}{'TRWAGMYFPDXBNJZSQVHLCKE'[(first * 10_000_000 + n) % 23]}"
    if kind == 12:
        pick = lambda n: "".join(r.choice("ABCDEFGHILMNOPRSTUVZ") for _ in range(n))
        return f"{pick(6)}{d('99')}{r.choice('ABCDEHLMPRST')}{d('99')}{pick(1)}{d('999')}{pick(1)}"
    return d(r.choice(("899.999.999-99", "9999 9999 9999", "899999-9999", "89999999999", "999-999-999 99", "12 999999 A 999", "999 999 999", "9999 999999", "943 476 9999")))


def _word(r: random.Random) -> str:
    """A word that nobody has seen, so that a number's shape must speak for itself."""
    word = "".join(r.choice("bcdfglmnprstvz") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    return r.choice((word, word.capitalize(), f"the {word}", f"{word} no."))


def _other(r: random.Random) -> str:
    """A number that names no person: a fixed shape, or a code of letters and digits."""
    if r.random() < 0.6:
        return digits(r, r.choice(_OTHER))
    letters = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(r.randint(1, 3)))
    if r.random() < 0.25:  # a parcel's or device's code
        return f"{letters}{digits(r, '9' * r.randint(7, 12))}{r.choice(('', letters, 'ZA'))}"
    number = digits(r, "9" * r.randint(4, 7))
    form = r.randrange(4)
    if form == 0:
        return f"{letters}{r.choice('-/ ')}{number}"
    if form == 1:
        return f"{letters}{number}"
    if form == 2:
        return f"{number}-{letters[0]}"
    return f"{digits(r, '9999')}{r.choice('-/')}{digits(r, '99')}{r.choice('-/')}{letters[0]}"


def _street(r: random.Random) -> str:
    k = r.randrange(4)
    no = str(r.randint(1, 240)) + (r.choice("abc") if r.random() < 0.12 else "")
    if k == 0:
        return f"{no} {r.choice(_EN)} {r.choice(_TYPES_FRONT)}"
    if k == 1:
        return f"{no}{r.choice(('', '', ' bis', ' ter', ','))} {r.choice(_FR)} {r.choice(_FR_OF)}"
    if k == 2:
        return r.choice((f"{r.choice(_DE_HEAD)}{r.choice(_DE_TAIL)} {no}", f"Am {r.choice(_DE_HEAD)}platz {no}", f"{r.choice(_DE_HEAD)}er {r.choice(('Straße', 'Weg', 'Allee'))} {no}"))
    return f"{r.choice(_ES)} {r.choice(_ES_OF)}{r.choice((' ', ', ', ', n.º ', ' nº '))}{no}"


def _mail(r: random.Random, given: str, family: str) -> str:
    plain = lambda s: re.sub(r"[^a-z]", "", s.lower()) or "office"
    local = r.choice((f"{plain(given)}.{plain(family)}", f"{plain(family)}_{plain(given)}", f"{plain(given)[:1]}{plain(family)}", f"{plain(given)}{r.randint(1, 99)}", "info", "help-desk", f"{plain(given)}.{plain(family)}+news"))
    host = r.choice(("mail", "north-shop", "lake.office", "uni", "post")) + "." + r.choice(("example", "test", "invalid", "org", "com", "de"))
    k = r.randrange(8)
    if k in (0, 4):
        return f"{r.choice((local, local[:1]))} [at] {host.replace('.', ' [dot] ')}"
    if k == 1:
        return f"{local} AT {host.replace('.', ' DOT ')}"
    if k == 2:
        return f"{local}{r.choice(('(at)', '＠', '&#64;', ' @ '))}{host}"
    return (f"{local}@{host}".upper() if k == 3 else f"{local}@{host}")


_SYLLABLES = ("ka", "lo", "mi", "ren", "tov", "sar", "bel", "dun", "vik", "ost", "har", "ne", "un", "fre", "ber", "der", "mer", "kan", "gol", "wit", "per", "al", "ster", "mon", "ti", "ru", "bra", "quin", "el", "zo")


_FIRM = (
    "Support", "Billing", "Office", "Services", "Metrics", "Freight", "Logistics", "Partners", "Team", "Desk", "Systems", "Notices", "Bank", "Hotel", "Group", "Travel", "Insurance", "Energy", "Studio", "Clinic", "School", "Post Office", "Helpdesk", "Newsletter", "Accounts", "Operations", "Alerts", "Press", "Store", "GmbH", "Ltd", "Inc",
)


def _firm(r: random.Random) -> str:
    """A firm, desk or room with a name of its own."""
    head = "".join(r.choice(_SYLLABLES) for _ in range(2)).capitalize() if r.random() < 0.5 else r.choice(("Silver", "Blue", "Harbour", "Stone", "River", "Bright", "Grand", "First", "North", "City", "Amber", "Falcon", "IT", "Mail"))
    return f"{head} {r.choice(_FIRM)}" if r.random() < 0.8 else f"{head} {r.choice(_EN)} {r.choice(_FIRM)}"


def _name(r: random.Random, people: list[tuple[str, str]]) -> str:
    if people and r.random() < 0.5:
        given, family = r.choice(people)
    else:
        given, family = r.choice(GIVEN), r.choice(FAMILY)
        x = r.random()
        if x < 0.08:
            family = f"{r.choice(PARTICLES)} {family}"
        elif x < 0.16:
            family = f"{family} {r.choice(FAMILY)}"
        elif x < 0.2:
            family = f"{family}-{r.choice(FAMILY)}"
        elif x < 0.24:
            given = f"{given} {r.choice(GIVEN)}"
        elif x < 0.42:  # one that no list has
            made = lambda n: "".join(r.choice(_SYLLABLES) for _ in range(n)).capitalize()
            family = made(r.randint(2, 3))
            if x < 0.35:
                given = made(2)
    k = r.randrange(12)
    if k < 6 or k in (6, 7, 11) and family.split(" ")[0].lower() in {p.split()[0] for p in PARTICLES}:
        return f"{given} {family}"
    if k == 6:
        return f"{family}, {given}"
    if k == 7:
        return f"{family if ' ' in family else family.upper()} {given}"
    if k == 8:
        return f"{given[0]}. {family}"
    if k == 9:
        return f"{given} {r.choice('ABDEFJKLMRST')}. {family}"
    if k == 10 and " " not in family:
        return f"{given.upper()} {family.upper()}"
    return f"{family} {given}"


#: Sentences in which codes stand that belong to things.
_CODE_FRAMES = (
    "Please read the note on the new form ({x}).", "The second copy ({x}) is in the drawer.", "Version {v} is out.", "Build {v} was put on the server.", "Release {v} of the tool", "firmware {v}, patch {v}", "La demande du client ({x}) avance.", "Le contrat de la société ({x}). La suite arrive.", "El envío del cliente ({x}). Gracias por todo.", "La cuenta anual ({x}) está cerrada.",
    "Der Antrag der Firma ({x}). Weiteres folgt.", "Die neue Liste : 12 / {x}.", "O pedido da loja ({x}). Obrigado.", "La pratica del cliente ({x}) è chiusa.", "Заявка клиента ({x}). Спасибо.", "page 4 / {x}", "kept under {x} in the archive", "and mention {x}.", "la lettre du mois : 310 / {x}", "file {x}: see the annex", "with the old list and name {x}.", "Nach dem Plan: 77 / {x}", "build {v}", "driver {v} fails",
)

KIND_OF = {"n": "name", "phone": "phone", "x": None, "s": "street", "m": "email", "mail": "email"}


def _fill(r: random.Random, frame: str, people: list, kind: str | None, cue: str = "") -> tuple[str, set[tuple[int, int, str]]]:
    text, gold, at = "", set(), 0
    given, family = r.choice(people) if people and r.random() < 0.5 else (r.choice(GIVEN), r.choice(FAMILY))
    for m in re.finditer(r"\{(\w+)\}", frame):
        text += frame[at : m.start()]
        at = m.end()
        slot, label = m[1], KIND_OF.get(m[1])
        if slot == "c":
            got = cue
        elif slot in ("x", "y"):
            label = kind
            got = _phone(r) if kind == "phone" else _id(r) if kind == "national_id" else _other(r)
        elif slot == "v":
            got = f"{r.randint(0, 300)}.{r.randint(0, 300)}" + (f".{r.randint(0, 9999)}" if r.random() < 0.8 else "")
        elif slot == "n":
            got = _name(r, people)
        elif slot == "b":
            got = r.choice(_NO_NAMES) if r.random() < 0.6 else _firm(r)
        elif slot == "s":
            got = _street(r)
        elif slot == "k":
            got = str(r.randint(1, 400))
        elif slot == "town":
            got = r.choice(_TOWN)
        elif slot == "phone":
            got = _phone(r)
        else:
            got = _mail(r, given, family)
        if label:
            gold.add((len(text), len(text) + len(got), label))
        text += got
    return text + frame[at:], gold


#: Share of frames that are left out of fitting when accuracy is measured.
HELD = 5


def labelled(people: list[tuple[str, str]], seed: int, n: int, held: bool | None = None) -> Iterator[tuple[str, bool, set[tuple[int, int, str]]]]:
    """``n`` texts; ``held`` True or False: only the frames held out for a test, or only the others."""
    r = random.Random(seed)
    pick = lambda xs: [x for i, x in enumerate(xs) if held is None or (i % HELD == 2) == held]
    groups = (
        (6, lambda: (r.choice(pick(_NAME_FRAMES)), None, "")), (5, lambda: (r.choice(pick(_NO_NAME_FRAMES)), None, "")), (4, lambda: (r.choice(pick(_PHONE_FRAMES)), "phone", r.choice(pick(_PHONE_CUES)))),
        (5, lambda: (r.choice(pick(_ID_FRAMES)), "national_id", r.choice(pick(_ID_CUES)))), (9, lambda: (r.choice(pick(_OTHER_FRAMES)), None, r.choice(pick(_OTHER_CUES)) if r.random() < 0.5 else _word(r))), (5, lambda: (r.choice(pick(_CODE_FRAMES)), None, "")), (3, lambda: (r.choice(pick(_STREET_FRAMES)), None, "")),
        (2, lambda: (r.choice(pick(_NO_STREET_FRAMES)), None, "")), (4, lambda: (r.choice(pick(_MAIL_FRAMES)), None, "")), (1, lambda: (r.choice(pick(_NO_MAIL_FRAMES)), None, "")),
    )
    weights = [w for w, _ in groups]
    for _ in range(n):
        if r.random() < 0.16:
            text, gold = _fill(r, r.choice(pick(_ADDRESS_FRAMES)), people, None)
            yield text, True, {g for g in gold if g[2] != "email"}
            continue
        parts = [_fill(r, *_reorder(make(), people)) for _, make in r.choices(groups, weights, k=r.randint(1, 3))]
        text, gold = "", set()
        for t, g in parts:
            if text:
                text += r.choice((" ", "\n", " ", "<br>", "</p>\n<p>"))
            gold |= {(a + len(text), b + len(text), k) for a, b, k in g}
            text += t
        yield text, False, gold


def _reorder(made: tuple[str, str | None, str], people: list) -> tuple:
    frame, kind, cue = made
    return frame, people, kind, cue
