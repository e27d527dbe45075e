"""How plausible a text is: character pairs of many languages, fitted on a small sample.

``SAMPLES`` holds a few sentences of each of some fifty languages (the first article of
the Universal Declaration of Human Rights, a public text, and plain everyday words), with
the letters beyond a to z that the language writes.  ``Model`` counts letter pairs in
them.  The cost of a text, in nats, is that of its letters beyond ASCII and of the letters
after them, in the language that reads them best, plus that of symbols where they stand.
The sample is the whole training set (a fixed bound); letters of scripts without a sample
get a flat cost.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np

#: language: (letters beyond a-z, sample)
SAMPLES: dict[str, tuple[str, str]] = {
    "en": ("àâäåçèéêëíïñóôöøûü", "naïve café résumé façade Zoë coöperate déjà vu fiancé décor cliché exposé touché vis-à-vis jalapeño smörgåsbord Ångström señor piñata château crème brûlée rôle"),
    "fr": ("àâæçéèêëîïôœùûüÿ", "Tous les êtres humains naissent libres et égaux en dignité et en droits. Ils sont doués de raison et de conscience et doivent agir les uns envers les autres dans un esprit de fraternité. Après la réunion décalée, équipe réseau a déjà reçu la pièce jointe à côté du dépôt, où êtes vous, été prévu très bientôt, merci être là. Le relevé, la référence, le numéro, même problème, ça va, français, leçon, hôtel, forêt, août, sûr, naïf, Noël, œuvre, cœur, élève, règle, première, société, sécurité, qualité, télécharger, vérifier, créé, envoyé, reçue, répondre, délai, matériel, système, accès, clé, château, contrôle, bâtiment, tâche, connaître, île, goût, coûter, fenêtre, intérêt, prêt, arrêter, échéance, état, étape, équipement, à partir, voilà, déjà, mémoire, général, différent, préféré, modèle, deuxième, mère, père, dernière, entrée, année, journée, idée, arrivée, donnée, améliorer, dépêche, récente, complète, précédent, précède, siège, boîte, grâce à, abîmer, économique, coûteux, piqûre, dîner, traître, maître, âge, âme, pâte, rôle, côte, drôle, extrême, rêve, crème, piège, espèce, élevé, collègue, enquête, clôture, sœur, manœuvre, maïs, haïr"),
    "es": ("áéíñóúü", "Todos los seres humanos nacen libres e iguales en dignidad y derechos y, dotados como están de razón y conciencia, deben comportarse fraternalmente los unos con los otros. El número de trámite canceló la campaña, sí, también después del año, información, está aquí, según día, más rápido, página, título, código, teléfono, dirección, reunión, versión, sesión, acción, gestión, última, próximo, pequeño, mañana, señor, español, compañía, contraseña, envío, país, todavía, podrá, será, habrá, recibió, envió, llegó, único, público, política, técnico, crédito, débito, artículo, vehículo, económico, histórico, electrónico, móvil, fácil, difícil, útil, así, allí, línea, área, único, vergüenza, pingüino, cigüeña, niño, cómo, qué, cuándo, dónde, quién, avería, cortés, periódico, jueves, miércoles, sábado"),
    "pt": ("áâãàçéêíóôõúü", "Todos os seres humanos nascem livres e iguais em dignidade e em direitos. Dotados de razão e de consciência, devem agir uns para com os outros em espírito de fraternidade. A manutenção anual não está ligada às estações; até amanhã, você também já recebeu a informação, atenção, ligação, reunião, sessão, versão, não são então, mãe, irmão, pão, põe, ações, opções, condições, três, mês, português, último, público, técnico, código, número, página, título, endereço, serviço, preço, começo, cabeça, força, avó, avô, à noite, às vezes, água, área, história, próximo, difícil, possível, fácil, útil, país, saída, incluído, consequência, câmara, câmbio, experiência, aliança, solução, situação, organização, produção, configuração, atualização, cartão, televisão, órgão, bênção, lâmpada, ônibus, têm, vêm, além, ninguém, porém, armazém, relatório, escritório, horário"),
    "de": ("äöüßé", "Alle Menschen sind frei und gleich an Würde und Rechten geboren. Sie sind mit Vernunft und Gewissen begabt und sollen einander im Geiste der Brüderlichkeit begegnen. Über die Außenstelle läuft größtenteils die Prüfung für Müller, schöne Grüße, Straße, können, müssen, dürfen, möchte, während, später, nächste, Änderung, Übersicht, Rückfrage, Gebühr, natürlich, möglich, gewährleisten, Büro, früh, fünf, zwölf, Stück, Brücke, grün, schließen, wöchentlich, jährlich, heißt, weiß, groß, muß, Fuß, Maßnahme, Verfügung, Geschäft, Gerät, Verspätung, Bestätigung, ausgewählt, erklären, zählen, hätte, wäre, würde, zurück, prüfen, Öffnung, öffentlich, höher, lösen, gehören, hören, Köln, München, Österreich, überprüft, gültig, ungültig, Schlüssel, Mädchen, Häuser, Bäume, Äpfel, Öl, Ärger, üblich, außerdem, überfällig, verknüpft, knüpfen, Lieferung, kühn, glühen, dünn, hübsch, rösten, trösten, fröhlich, plötzlich, völlig, gänzlich, ländlich, kräftig, mächtig, nämlich, ähnlich, Nähe, Mühe, Tür, Gefühl"),
    "it": ("àèéìíîòóùú", "Tutti gli esseri umani nascono liberi ed eguali in dignità e diritti. Essi sono dotati di ragione e di coscienza e devono agire gli uni verso gli altri in spirito di fratellanza. Perché è già così più città, università, lunedì, però, sarà, può, verrà, virtù, caffè, cioè, né, libertà, attività, società, qualità, là, lì, giù, sì, metà, età"),
    "ca": ("àçèéíïòóúü", "Tots els éssers humans neixen lliures i iguals en dignitat i en drets. Són dotats de raó i de consciència, i han de comportar-se fraternalment els uns amb els altres. Això és també així, però què més, màquina, França, açò, plaça, història, països, qüestió, català, informació"),
    "nl": ("áèéëïóöüç", "Alle mensen worden vrij en gelijk in waardigheid en rechten geboren. Zij zijn begiftigd met verstand en geweten en behoren zich jegens elkander in een geest van broederschap te gedragen. België, één, coördinatie, geïnteresseerd, ideeën, café, zoëven, reünie, financiële, officiële, patiënt, vóór, hé"),
    "sv": ("åäöéà", "Alla människor är födda fria och lika i värde och rättigheter. De har utrustats med förnuft och samvete och bör handla gentemot varandra i en anda av gemenskap. På måndag får vi också några frågor från våra kunder, även förändringar, är ålder, över, så, då, när, här, där, för, öppna, kök, språk, år, åtta, idé, två, åka, gå, stå, än, ännu, välkommen, hälsningar, säkerhet, behöver, göra, höger, vänster"),
    "da": ("æøåéü", "Alle mennesker er født frie og lige i værdighed og rettigheder. De er udstyret med fornuft og samvittighed, og de bør handle mod hverandre i en broderskabets ånd. På mandag får vi også nogle spørgsmål fra vores kunder, første ændring, være, gør, før, når, så, år, blå, rød, grøn, lørdag, søndag, fælles, læse, væk, åben, småting, København, både, hånd, påske, ærlig, øl, år, æble, å, også, må, få, stå, træ, kærlig"),
    "no": ("æøåéòôó", "Alle mennesker er født frie og med samme menneskeverd og menneskerettigheter. De er utstyrt med fornuft og samvittighet og bør handle mot hverandre i brorskapets ånd. På måndag får vi også noen spørsmål fra våre kunder, første, være, gjøre, før, når, så, år, blå, rød, grønn, lørdag, søndag, åpen, både, hånd, påske, ærlig, øl, også, må, få, stå, trær, skjønner, kjøre, språk"),
    "fi": ("äöåšžé", "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä. Tämä päivä, hyvää yötä, työ, käyttäjä, sähköposti, löytää, älä, mitään, täällä, myös, näin, että, pöytä, äiti, isä, määrä, tärkeä"),
    "is": ("áðéíóúýþæö", "Hver maður er borinn frjáls og jafn öðrum að virðingu og réttindum. Menn eru gæddir vitsmunum og samvisku og ber að breyta bróðurlega hverjum við annan. Það er ekki það sem ég ætlaði að segja, þú, því, þegar, fyrir, mjög, góðan daginn, íslenska, ár, ný, sýna, útlönd, hús, æ, við, með, frá, síðan, þetta, þó, já, ís, öll"),
    "pl": ("ąćęłńóśźż", "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa. Proszę o odpowiedź, dziękuję, że już może być więcej, również, środa, piątek, główny, źródło, żółty, łódź, książka, część, ćwiczenie, pięć, dzień, koń, państwo, później, miesiąc, wiadomość, załącznik, płatność, usługa, zamówienie, który, są, będzie, gdzieś, wyślij, Łukasz, święto, śnieg, źle, też, wciąż, można, należy, każdy, jeśli, dość, ość, mówić, róża, góra, córka, zażółć, gęś, jaźń, ładny, niż"),
    "cs": ("áčďéěíňóřšťúůýž", "Všichni lidé rodí se svobodní a sobě rovní co do důstojnosti a práv. Jsou nadáni rozumem a svědomím a mají spolu jednat v duchu bratrství. Dobrý den, děkuji, prosím, můžete, příloha, žádost, není, když, číslo, řešení, účet, ještě, už, kůň, pěkný, žluťoučký, příliš, úpěl, ďábelské, ódy, být, dnes, měsíc, týden, které, další, šest, čtyři, třetí, část, věc, zpráva, společnost, děti, třída, loď, město, náměstí, právě, svůj, dům, řeka, šťastný, říkat, středa, čtvrtek, pátek, někdy, přes, při, před, zítra, tělo, něco"),
    "sk": ("áäčďéíĺľňóôŕšťúýž", "Všetci ľudia sa rodia slobodní a sebe rovní, čo sa týka ich dôstojnosti a práv. Sú obdarení rozumom a majú navzájom jednať v bratskom duchu. Ďakujem, prosím, môžete, príloha, žiadosť, nie je, keď, číslo, riešenie, účet, ešte, už, kôň, deň, týždeň, ktoré, ďalší, šesť, štyri, tretí, časť, vec, správa, spoločnosť, vŕba, stĺp, mäso, päť, ľahký, môj, tôňa"),
    "hu": ("áéíóöőúüű", "Minden emberi lény szabadon születik és egyenlő méltósága és joga van. Az emberek, ésszel és lelkiismerettel bírván, egymással szemben testvéri szellemben kell hogy viseltessenek. Köszönöm szépen, kérjük, küldje el a választ, időpont, szükséges, győr, hétfő, több, először, fűtés, gyűjtemény, tűz, víz, út, üzenet, könyv, közösség, működik, jövő, nő, nők, erő, idő, szőlő, őket, ő, ősz, írni, október, árvíztűrő tükörfúrógép, van, hogy, már, még, két, négy, öt, hét, tíz, húsz, száz, után, között, előtt, jó, új, régi, magyar, ország, élet, ég, tükör, fúró, gép"),
    "ro": ("ăâîșțşţ", "Toate ființele umane se nasc libere și egale în demnitate și în drepturi. Ele sunt înzestrate cu rațiune și conștiință și trebuie să se comporte unele față de altele în spiritul fraternității. Vă mulțumesc, până mâine, informații, și, că, fără, după, către, română, țară, București, întâlnire, încă, înainte, această, cărți, viață, oraș, şi, ţară, fiinţe, raţiune, conştiinţă, mulţumesc, întâi, când, cât, atât, sâmbătă, găsi, băiat"),
    "hr": ("čćđšž", "Sva ljudska bića rađaju se slobodna i jednaka u dostojanstvu i pravima. Ona su obdarena razumom i sviješću i trebaju jedna prema drugima postupati u duhu bratstva. Molimo pošaljite odgovor, također, što, želim, važno, već, riječ, noć, kuća, mogućnost, žena, čovjek, četvrtak, ćemo, među, između, sljedeći, obavijest, Đuro, šest, život, možete, hoće, naći, duž, češće, još, naš, vaš, priča, točka, može"),
    "sl": ("čšž", "Vsi ljudje se rodijo svobodni in imajo enako dostojanstvo in enake pravice. Obdarjeni so z razumom in vestjo in bi morali ravnati drug z drugim kakor bratje. Prosimo, pošljite, že, še, čas, človek, življenje, več, noč, hiša, možnost, češnja, šola, žena, naš, vaš, kaj, kdo, mož, začetek, tržišče"),
    "lt": ("ąčęėįšųūž", "Visi žmonės gimsta laisvi ir lygūs savo orumu ir teisėmis. Jiems suteiktas protas ir sąžinė ir jie turi elgtis vienas kito atžvilgiu kaip broliai. Ačiū, prašome, į, iš, už, žodis, lietuvių, kalbą, būti, šį, tą, jų, mūsų, jūsų, gražūs, žinoma, čia, kęsti, įmonė, sąskaita, siųsti, užklausą, šią, ąžuolas, vėl"),
    "lv": ("āčēģīķļņšūž", "Visi cilvēki piedzimst brīvi un vienlīdzīgi savā pašcieņā un tiesībās. Viņi ir apveltīti ar saprātu un sirdsapziņu, un viņiem jāizturas citam pret citu brālības garā. Lūdzu, paldies, latviešu, ģimene, ķermenis, ļoti, šī, būs, mūsu, jūsu, tūlīt, žēl, ēka, īss, ūdens, āda, zaļš, rēķins, vēstule, ņemt, veļa, kāpēc, tāpēc, šķirt"),
    "et": ("äöõüšž", "Kõik inimesed sünnivad vabadena ja võrdsetena oma väärikuselt ja õigustelt. Neile on antud mõistus ja südametunnistus ja nende suhtumist üksteisesse peab kandma vendluse vaim. Palun, täna, õhtu, öö, küsimus, või, võib, käsi, töö, jõgi, mõte, külm, üks, pärast, süda, sõber, kõne, jää, öelda, põhi"),
    "tr": ("çğıİöşüâîû", "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler. Türkçe şifre, lütfen, teşekkürler, değil, için, çok, öğrenci, güneş, ışık, kış, şey, yıl, gün, İstanbul, ağaç, dağ, çalışma, müşteri, şirket, ödeme, hesabınız, sayın, ılık, değişiklik, özür, üç, dört, altı, bağlantı, bilgisayarı, kâğıt, şöyle, böyle, çünkü, başlık, geçmiş"),
    "az": ("çəğıİöşü", "Bütün insanlar ləyaqət və hüquqlarına görə azad və bərabər doğulurlar. Onların şüurları və vicdanları var və bir birlərinə münasibətdə qardaşlıq ruhunda davranmalıdırlar. Çox sağ olun, gözəl, şəhər, üçün, deyil, məktub, ölkə, ağac, bəli, əla, ışıq"),
    "vi": ("àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ", "Tất cả mọi người sinh ra đều được tự do và bình đẳng về nhân phẩm và quyền. Mọi con người đều được tạo hóa ban cho lý trí và lương tâm và cần phải đối xử với nhau trong tình bằng hữu. Xin chào, cảm ơn, ngày, tháng, năm, thư, điện thoại, địa chỉ, không, của, những, là, có, một, hai, bốn, sáu, bảy, tám, chín, mười, nước, Việt, Nguyễn, Trần, tiếng, để, nếu, thì, rất, vẫn, sẽ, đã, đang, quá, giờ, ở, từ, lần, hơn"),
    "sq": ("çëé", "Të gjithë njerëzit lindin të lirë dhe të barabartë në dinjitet dhe në të drejta. Ata kanë arsye dhe ndërgjegje dhe duhet të sillen ndaj njëri tjetrit me frymë vëllazërimi. Çfarë, është, për, më, një, këtë, shqipërisë, ç, çdo, nënë, jetë"),
    "ga": ("áéíóú", "Saolaítear gach duine den chine daonna saor agus comhionann i ndínit agus i gcearta. Tá bua an réasúin agus an choinsiasa acu agus ba cheart dóibh gníomhú i dtreo a chéile i spiorad an bhráithreachais. Áit, éan, ísle, óg, úr, sláinte, tír, fáilte, cúig, bóthar"),
    "cy": ("âêîôûŵŷáéíóúïä", "Genir pawb yn rhydd ac yn gydradd mewn urddas a hawliau. Fe'u cynysgaeddir â rheswm a chydwybod, a dylai pawb ymddwyn y naill at y llall mewn ysbryd cymodlon. Tŷ, dŵr, môr, iâ, tân, cân, gŵr, ŷd, ŵy, tê, sŵn, llên, pêl, tîm"),
    "mt": ("ċġħżàèìòù", "Il bnedmin kollha jitwieldu ħielsa u ugwali fid dinjità u d drittijiet. Huma mogħnija bir raġuni u bil kuxjenza u għandhom iġibu ruħhom ma xulxin bi spirtu ta aħwa. Ċavetta, żmien, ġurnata, ħobż, grazzi ħafna, għal, żgħir, ċert"),
    "eo": ("ĉĝĥĵŝŭ", "Ĉiuj homoj estas denaske liberaj kaj egalaj laŭ digno kaj rajtoj. Ili posedas racion kaj konsciencon, kaj devus konduti unu al alia en spirito de frateco. Ĝis, ĵaŭdo, ŝi, eĥo, aŭ, ĉe, antaŭ, paĝo, manĝi, ŝati"),
    "ru": ("абвгдежзийклмнопрстуфхцчшщъыьэюяё", "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства. Сегодня годовая проверка переносит ваша заявка, уважаемый клиент, входящая ссылка закрыта, здравствуйте, спасибо, пожалуйста, подтвердите получение, вложение, счёт, ёлка, ещё, её, что, это, который, объект, съезд, этот, нужно, чтобы, если, также, можно, только, сейчас, очень, будет, общий, площадь, июнь, январь, вышел, ушёл, цена, фото, хорошо, жизнь, шесть, эхо, юг, я, мы, вы, они, для, при, без, под, над, между, через, после, перед, письмо, сообщение, документ, договор, встреча, отдел, служба, поддержка, группа, цель, центр, хранение, щит, ближайший, действие, проверьте, вопрос, ответ, работа, система, компания, безопасность"),
    "uk": ("абвгґдеєжзиіїйклмнопрстуфхцчшщьюя", "Всі люди народжуються вільними і рівними у своїй гідності та правах. Вони наділені розумом і совістю і повинні діяти у відношенні один до одного в дусі братерства. Будь ласка, дякую, її, єдиний, ґанок, їжак, мова, українська, що, це, який, має, можна, цього, після, перед, від, під, сьогодні, рішення, підтвердьте, рахунок, ціна, щоб, якщо, й, і, є, з, із, ці, їх, їм, інші, дві, дії, події, країна"),
    "be": ("абвгдеёжзійклмнопрстуўфхцчшыьэюя", "Усе людзі нараджаюцца свабоднымі і роўнымі ў сваёй годнасці і правах. Яны надзелены розумам і сумленнем і павінны ставіцца адзін да аднаго ў духу брацтва. Дзякуй, калі ласка, гэта, што, яшчэ, ёсць, быў, праўда, мова, беларуская, цяпер, воўк, дзень, сёння, ў"),
    "bg": ("абвгдежзийклмнопрстуфхцчшщъьюя", "Всички хора се раждат свободни и равни по достойнство и права. Те са надарени с разум и съвест и следва да се отнасят помежду си в дух на братство. Благодаря, моля, изпратете отговор, също, въпрос, първи, български, щом, къде, какво, това, който, ще, също, тъй, ъгъл, сън, път, съобщение, Уважаеми, ѝ"),
    "sr": ("абвгдђежзијклљмнњопрстћуфхцчџш", "Сва људска бића рађају се слободна и једнака у достојанству и правима. Она су обдарена разумом и свешћу и треба једни према другима да поступају у духу братства. Молимо пошаљите одговор, хвала, такође, његов, кућа, џеп, ђак, већ, између, још, пријатељ, недеља, љубав"),
    "mk": ("абвгдѓежзѕијклљмнњопрстќуфхцчџш", "Сите човечки суштества се раѓаат слободни и еднакви по достоинство и права. Тие се обдарени со разум и совест и треба да се однесуваат еден кон друг во духот на општо човечката припадност. Ќе, ноќ, куќа, ѕвезда, меѓу, љубов, благодарам, молам, уште, џеб, њива"),
    "kk": ("абвгғдеёжзиійкқлмнңоөпрстуұүфхһцчшщъыіьэюяә", "Барлық адамдар тумысынан азат және қадір қасиеті мен құқықтары тең болып дүниеге келеді. Адамдарға ақыл парасат, ар ождан берілген, сондықтан олар бір бірімен туыстық, бауырмалдық қарым қатынас жасаулары тиіс. Рахмет, өмір, үй, ұлт, әке, жаңа, күн, ғылым"),
    "el": ("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋΐΰ", "Όλοι οι άνθρωποι γεννιούνται ελεύθεροι και ίσοι στην αξιοπρέπεια και τα δικαιώματα. Είναι προικισμένοι με λογική και συνείδηση, και οφείλουν να συμπεριφέρονται μεταξύ τους με πνεύμα αδελφοσύνης. Ευχαριστώ πολύ, παρακαλώ, απάντηση, μήνυμα, ημέρα, σήμερα, αύριο, υπηρεσία, πελάτης, εταιρεία, τηλέφωνο, ψωμί, ζωή, ξένος, βιβλίο, ή, ό,τι, έχω, ώρα, ήταν, ύψος, άλλα, όχι, χώρα, Ελλάδα, γλώσσα, καφές, φίλος, σας, στη, θα, πώς, μαϊμού"),
    "he": ("אבגדהוזחטיכךלמםנןסעפףצץקרשת", "כל בני האדם נולדו בני חורין ושווים בערכם ובזכויותיהם. כולם חוננו בתבונה ובמצפון, לפיכך חובה עליהם לנהוג איש ברעהו ברוח של אחווה. שלום, תודה רבה, בבקשה, הודעה, חשבון, לקוח יקר, עברית, זה, של, את, עם, טוב, ספר, ארץ, סוף, דרך, צבע"),
    "ar": ("ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيًٌٍَُِّْ،؛؟", "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق. وقد وهبوا عقلا وضميرا وعليهم أن يعامل بعضهم بعضا بروح الإخاء. مرحبا، شكرا جزيلا، من فضلك، رسالة، حساب، العميل العزيز، اللغة العربية، هذا، التي، الذي، إلى، على، غير، ظهر، طريق، ثلاثة، خبز، صباح، ضوء، سؤال، شيء، مساء، قلب"),
    "fa": ("ءآأؤئابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهی،؛؟", "تمام افراد بشر آزاد به دنیا می آیند و از لحاظ حیثیت و حقوق با هم برابرند. همه دارای عقل و وجدان می باشند و باید نسبت به یکدیگر با روح برادری رفتار کنند. سلام، متشکرم، لطفا، پیام، حساب، زبان فارسی، چرا، گفت، ژاله"),
    "hi": ("अआइईउऊऋएऐओऔकखगघङचछजझञटठडढणतथदधनपफबभमयरलवशषसहािीुूृेैोौ्ंःँ़।ॐ", "सभी मनुष्यों को गौरव और अधिकारों के मामले में जन्मजात स्वतन्त्रता और समानता प्राप्त है। उन्हें बुद्धि और अन्तरात्मा की देन प्राप्त है और परस्पर उन्हें भाईचारे के भाव से बर्ताव करना चाहिए। नमस्ते, धन्यवाद, कृपया, संदेश, खाता, हिन्दी, यह, है, में, नहीं"),
    "th": ("กขคฆงจฉชซฌญฎฏฐฑฒณดตถทธนบปผฝพฟภมยรลวศษสหฬอฮะัาำิีึืุูเแโใไๆ็่้๊๋์ฯ", "มนุษย์ทั้งหลายเกิดมามีอิสระและเสมอภาคกันในเกียรติศักดิ์และสิทธิ ต่างมีเหตุผลและมโนธรรม และควรปฏิบัติต่อกันด้วยเจตนารมณ์แห่งภราดรภาพ สวัสดี ขอบคุณ กรุณา ข้อความ บัญชี ลูกค้า ภาษาไทย"),
    "ka": ("აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ", "ყველა ადამიანი იბადება თავისუფალი და თანასწორი თავისი ღირსებითა და უფლებებით. მათ მინიჭებული აქვთ გონება და სინდისი და ერთმანეთის მიმართ უნდა იქცეოდნენ ძმობის სულისკვეთებით."),
    "hy": ("աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցւփքօֆև", "Բոլոր մարդիկ ծնվում են ազատ ու հավասար իրենց արժանապատվությամբ ու իրավունքներով։ Նրանք ունեն բանականություն ու խիղճ և միմյանց պետք է եղբայրաբար վերաբերվեն։"),
}

LANGUAGES = tuple(SAMPLES)
LOST = "�"
#: What another language than that of the rest of a text costs a word.
OTHER_LANGUAGE = 2.0
#: What a character beyond ASCII costs in ordinary words, about, and what a token with any costs besides.
USUAL, BESIDES = 3.5, 2.0
#: symbol: ordinary cost, cost after a letter, cost before a letter, cost between letters (added)
_SEAT = {
    "’": (2.5, 1, 1, -1.5), "‘": (2.5, 2, 0, 2), "“": (2.5, 1, 0, 4), "”": (2.5, 0, 3, 4), "„": (2.8, 5, 0, 4), "‚": (3.5, 5, 1, 3), "«": (2.5, 2, 0, 4), "»": (2.5, 0, 2, 4),
    "‹": (5.5, 3, 0, 4), "›": (5.5, 0, 3, 4), "–": (2.5, 1.5, 1.5, 2), "—": (2.5, 1.5, 1.5, 2), "…": (2.5, 0, 1.5, 2),
    "€": (2.8, 4, 3, 3), "£": (3.5, 5, 3, 3), "¥": (4, 5, 3, 3), "¢": (4.5, 5, 4, 3),
    "©": (3.5, 5, 3, 3), "®": (3.5, 0, 4, 3), "™": (3.5, 0, 4, 3), "°": (3, 0.5, 2, 3), "º": (3.2, 0.5, 2, 3), "ª": (3.8, 1, 4, 3), "·": (3.5, 2, 2, 1), "•": (3, 5, 2, 3),
    "×": (3.8, 4, 4, 3), "±": (4, 5, 4, 3), "µ": (4, 5, 0, 3), "¿": (2.8, 6, 0, 4), "¡": (2.8, 6, 0, 4), "§": (3.2, 5, 2, 3), "¶": (5, 4, 3, 3), "†": (6, 2, 3, 3), "‡": (9.5, 3, 4, 3),
    "¬": (6, 4, 4, 3), "¦": (6, 4, 4, 3), "¨": (8, 4, 4, 3), "¯": (8, 4, 4, 3), "´": (5.5, 1.5, 2, 1), "¸": (8, 4, 4, 3), "¹": (5, 1.5, 5, 3), "²": (4.2, 0.5, 5, 3), "³": (4.5, 1, 5, 3),
    "¼": (5, 5, 4, 3), "½": (4.5, 5, 4, 3), "¾": (5, 5, 4, 3), "÷": (6, 4, 4, 3), "′": (5, 2, 4, 3), "″": (5, 3, 4, 3), "№": (3, 4, 2, 3), "→": (4, 3, 3, 3), "✓": (4, 3, 3, 3),
}
_NO_SEAT = (6.0, 3.0, 3.0, 1.0)


@lru_cache(maxsize=None)
def script(ch: str) -> str:
    """The script of a letter or mark, by its Unicode name; CJK scripts count as one."""
    if ch < "ʰ" and ch.isalpha():
        return "LATIN"
    word = unicodedata.name(ch, "?").split(" ")[0].split("-")[0]
    if word in ("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "BOPOMOFO"):
        return "CJK"
    return word


def _cjk(ch: str) -> float:
    """Cost of a Chinese, Japanese or Korean character: how common the national standards make it."""
    cp = ord(ch)
    if 0x3041 <= cp <= 0x30FF:
        return 2.8
    if 0xAC00 <= cp <= 0xD7A3:
        return 3.4 if _in(ch, "euc-kr", 0xB0, 0xC8) else 9.0
    rank = 8.0
    if _in(ch, "gb2312", 0xB0, 0xD7):
        rank = 3.6
    if _in(ch, "euc_jp", 0xB0, 0xCF):
        rank = min(rank, 3.8)
    if _in(ch, "big5", 0xA4, 0xC6):
        rank = min(rank, 4.2)
    return rank


def _in(ch: str, charset: str, low: int, high: int) -> bool:
    try:
        raw = ch.encode(charset)
    except UnicodeError:
        return False
    return len(raw) == 2 and low <= raw[0] <= high


class Kinds(dict):
    """Character -> (kind, flat cost): a ASCII letter, l other letter, s symbol, n ASCII other, x hardly text."""

    def __missing__(self, ch: str) -> tuple[str, float]:
        cp = ord(ch)
        cat = unicodedata.category(ch)
        if cp < 128:
            got = ("a", 0.0) if ch.isalpha() else ("n", 0.0)
        elif ch == LOST:
            got = ("s", 6.0)
        elif 0xFF01 <= cp <= 0xFF9F:
            got = ("l", 4.0) if ch.isalpha() else ("b" if ch in "＠．" else "c", 3.0)
        elif ch in _SEAT:
            got = ("s", _SEAT[ch][0])
        elif cat[0] == "L" or cat[0] == "M":
            got = ("l", 4.0)
        elif cp in (0xA0, 0x202F, 0x2009, 0x3000):
            got = ("b", 1.5)
        elif cp == 0xAD:
            got = ("b", 4.5)
        elif cat in ("Cf", "Zs", "Zl", "Zp"):
            got = ("b", 3.0)
        elif 0x3001 <= cp <= 0x303F:
            got = ("c", 3.0)
        elif 0x2500 <= cp < 0x25A0:
            got = ("x", 4.0)
        elif cat in ("Cc", "Co", "Cn", "Cs"):
            got = ("x", 12.0)
        elif cp >= 0x1F000 or 0x2600 <= cp < 0x27C0:
            got = ("b", 4.5)
        elif cat == "Nd":
            got = ("l", 4.5)
        else:
            got = ("s", 6.0)
        self[ch] = got
        return got


KINDS = Kinds()


def cp_blank(ch: str) -> bool:
    """Blanks that a misreading makes of letters: no-break space, marks of direction."""
    return ch in "\xa0\u200e\u200f\u2028\u2029"


def _low(ch: str) -> str:
    low = ch.lower()
    return low if len(low) == 1 else ch


#: Vowels by their plain letters; other letters count as consonants when a pair was not met.
VOWELS = frozenset("aeiouyæœøıə" "аеёиоуыэюяіїєѝ" "αεηιουω")


@lru_cache(maxsize=None)
def _side(ch: str) -> str:
    """^ at the start of a word, v a vowel, c another letter."""
    return "^" if ch == "^" else "v" if unicodedata.normalize("NFD", ch)[0] in VOWELS or ch in VOWELS else "c"


class Model:
    """Costs of letter pairs in every language; see the module's text."""

    def __init__(self) -> None:
        self.stats = []
        for extra, sample in SAMPLES.values():
            letters = set("abcdefghijklmnopqrstuvwxyz") | set(extra) if script(extra[0]) == "LATIN" else set(extra)
            single, pairs, firsts, sides, after = Counter(), Counter(), Counter(), Counter(), Counter()
            word = "^"
            for ch in unicodedata.normalize("NFC", sample) + " ":
                low = _low(ch)
                if KINDS[ch][0] not in "al":
                    low = "$"
                if word[-1] != "^" or low != "$":
                    pairs[word[-1], low] += 1
                    firsts[word[-1]] += 1
                    sides[_side(word[-1])] += 1
                    after[_side(word[-1]), low] += 1
                    single[low] += 1
                word = "^" if low == "$" else low
            self.stats.append((letters, single, pairs, firsts, sum(single.values()), script(extra[0]), sides, after, Counter(p for p, _ in pairs)))
        self.usual = np.array([*(USUAL if s[5] == "LATIN" else max(USUAL, math.log(len(s[0])) + 0.3) for s in self.stats), USUAL])
        self.vectors: dict[str, np.ndarray] = {}
        self.tokens: dict[str, tuple[np.ndarray | None, float, float, float]] = {}

    def vector(self, prev: str, ch: str) -> np.ndarray:
        """Cost of ``ch`` after ``prev`` in each language, and in one that no sample covers."""
        key = prev + ch
        got = self.vectors.get(key)
        if got is None:
            got = np.array([*(self._cost(s, prev, ch) for s in self.stats), self._unknown(prev, ch)])
            if len(self.vectors) > 200_000:
                self.vectors.clear()
            self.vectors[key] = got
        return got

    @staticmethod
    def _cost(stat: tuple, prev: str, ch: str) -> float:
        letters, single, pairs, firsts, total, own, sides, after, kinds = stat
        if ch != "$" and ch not in letters:
            return 9.5 if ch.isascii() or script(ch) == own else 12.0
        if prev not in ("^",) and prev not in letters:
            return 5.0
        n = firsts[prev]
        weight = n / (n + 2.0 * kinds[prev] + 1.0)  # letters that many kinds follow are met by new ones often
        side = _side(prev)
        uni = 0.6 * after[side, ch] / max(1, sides[side]) + 0.3 * single[ch] / total + 0.1 / (len(letters) + 1)
        return -math.log(weight * pairs[prev, ch] / n + (1 - weight) * uni if n else uni)

    @staticmethod
    def _unknown(prev: str, ch: str) -> float:
        if ch == "$" or ch.isascii():
            return 2.0
        kind = script(ch)
        if kind == "LATIN":
            return 7.5 if ord(ch) < 0x250 and ch not in "ƒªº" else 8.5
        if kind == "CYRILLIC":
            return 6.5
        if kind == "CJK":
            return _cjk(ch)
        if kind in ("GREEK", "HEBREW", "ARABIC"):
            return 6.5
        if kind in ("COMBINING", "MODIFIER", "FULLWIDTH", "HALFWIDTH"):
            return {"FULLWIDTH": 3.0}.get(kind, 6.0)
        return 5.0

    def token(self, tok: str) -> tuple[np.ndarray | None, float, float, float]:
        """(cost of its letters by language, the least of them, cost of its symbols, doubt)."""
        got = self.tokens.get(tok)
        if got is None:
            vec, base, units = self._token(unicodedata.normalize("NFC", tok))
            low = float(vec.min()) if vec is not None else 0.0
            beyond = float((vec - self.usual * units).min()) if vec is not None else -USUAL * units
            got = vec, low, base, (beyond + base - BESIDES) / units**0.5 if units else 0.0
            if len(tok) <= 64:
                if len(self.tokens) > 300_000:
                    self.tokens.clear()
                self.tokens[tok] = got
        return got

    def _token(self, tok: str) -> tuple[np.ndarray | None, float, int]:
        vec, base, units = None, 0.0, 0
        prev, plow, plain = "", "^", True  # last character, last letter, whether it was ASCII
        last = len(tok) - 1
        for i, ch in enumerate(tok):
            kind, flat = KINDS[ch]
            if kind == "a" or kind == "l":
                ascii_ = kind == "a"
                low = _low(ch)
                if not ascii_ or not plain:
                    v = self.vector(plow, low)
                    vec = v.copy() if vec is None else vec + v
                    if not ascii_:
                        units += 1
                    if plow != "^":
                        if low != ch and prev == plow and prev.islower():
                            base += 2.5 if ascii_ else 7.0
                        a, b = script(plow), script(low)
                        if a != b and "COMBINING" not in (a, b):
                            base += 5.0 if "CJK" in (a, b) else 6.0
                        elif ascii_ is False and low == ch and prev != plow and i > 1 and tok[i - 2].isupper():
                            base += 2.0  # a small letter in a word of capitals
                    elif low != ch and not ascii_ and i < last and not tok[i + 1].isalpha() and not tok[i + 1].isascii():
                        base += 3.0  # a capital, then a symbol
                prev, plow, plain = ch, low, ascii_
                continue
            if not plain:
                v = self.vector(plow, "$")
                vec = v.copy() if vec is None else vec + v
            if kind == "n":
                if ch in "\\^`~|{}$" and (not plain or i < last and not tok[i + 1].isascii()):
                    base += 4.0
            else:
                units += 1
                base += flat
                left = KINDS[prev][0] in "al" if prev else False
                right = i < last and KINDS[tok[i + 1]][0] in "al"
                if kind == "s" and ch != LOST:
                    _, after, before, between = _SEAT.get(ch, _NO_SEAT)
                    if ch == "°" and right and tok[i + 1].isupper():
                        before = 0.0  # degrees of a scale
                    elif ch in "€£¥¢" and i < last and not tok[i + 1].isascii():
                        before = 2.0
                        base += 2.0
                    base += after * left + before * right + between * (left and right)
                    if prev and KINDS[prev][0] in "sx" and prev != ch and ch not in "’”»…" and not (prev in "“«„‘" and ch in "“«„‘"):
                        base += 2.5  # symbols in a row
                elif kind == "x":
                    base += 6.0 * (left + right)
                elif kind == "c":  # punctuation of eastern Asia in words of other scripts
                    base += 4.0 * ((left and script(prev) != "CJK") + (right and script(tok[i + 1]) != "CJK"))
                elif cp_blank(ch):
                    base += 5.0 * (left and right) + 1.5 * (left or right)
                elif ch in "\u200c\u200d" and left and script(prev) in ("LATIN", "CYRILLIC", "GREEK"):
                    base += 6.0  # joiners belong to other scripts
            prev, plow, plain = ch, "^", True
        if not plain:
            v = self.vector(plow, "$")
            vec = v.copy() if vec is None else vec + v
        return vec, base, units

    def cost(self, text: str) -> float:
        return self.judge(text)[0]

    def judge(self, text: str) -> tuple[float, float]:
        """(cost of a text in nats, doubt of its least plausible token).

        A token's doubt is what it costs beyond ``USUAL`` nats a character (more in scripts
        of many letters) and ``BESIDES``, over the root of the number of its characters beyond ASCII.
        """
        if text.isascii():
            return 0.0, 0.0
        vecs, lows, total, worst = [], [], 0.0, 0.0
        for tok in TOKENS.findall(text):
            if tok.isascii():
                continue
            vec, low, base, doubt = self.token(tok)
            total += base
            if vec is not None:
                vecs.append(vec)
                lows.append(low)
            if doubt > worst:
                worst = doubt
        if len(vecs) == 1:
            total += lows[0]
        elif vecs:
            table = np.minimum(np.array(vecs), np.array(lows)[:, None] + OTHER_LANGUAGE)
            total += float(table.sum(0).min())
        return total, worst

    def doubtful(self, text: str, above: float) -> list[str]:
        """The distinct tokens whose doubt is more than ``above``, in order."""
        found = {}
        for tok in TOKENS.findall(text):
            if not tok.isascii() and tok not in found:
                found[tok] = self.token(tok)[3] > above
        return [t for t, bad in found.items() if bad]


TOKENS = re.compile(r"[^\x00-\x20]+")


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()
