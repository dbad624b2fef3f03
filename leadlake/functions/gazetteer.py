"""Bulgarian provinces and their municipal seats, for matching places in text."""

#: Province (lower case): its seats, in the order in which they are tried.
PROVINCES = {
    "благоевград": "Благоевград|Банско|Белица|Гоце Делчев|Гърмен|Кресна|Петрич|Разлог|Сандански|Сатовча|Симитли|Струмяни|Хаджидимово|Якоруда".split("|"),
    "бургас": "Бургас|Айтос|Камено|Карнобат|Малко Търново|Несебър|Поморие|Приморско|Руен|Созопол|Средец|Сунгурларе|Царево".split("|"),
    "варна": "Варна|Аврен|Аксаково|Белослав|Бяла|Ветрино|Вълчи дол|Девня|Долни чифлик|Дългопол|Провадия|Суворово".split("|"),
    "велико търново": "Велико Търново|Горна Оряховица|Елена|Златарица|Лясковец|Павликени|Полски Тръмбеш|Свищов|Стражица|Сухиндол".split("|"),
    "видин": "Видин|Белоградчик|Бойница|Брегово|Грамада|Димово|Кула|Макреш|Ново село|Ружинци|Чупрене".split("|"),
    "враца": "Враца|Борован|Бяла Слатина|Козлодуй|Криводол|Мездра|Мизия|Оряхово|Роман|Хайредин".split("|"),
    "габрово": "Габрово|Дряново|Севлиево|Трявна".split("|"),
    "добрич": "Добрич|Балчик|Генерал Тошево|Каварна|Крушари|Тервел|Шабла".split("|"),
    "кърджали": "Кърджали|Ардино|Джебел|Кирково|Крумовград|Момчилград|Черноочене".split("|"),
    "кюстендил": "Кюстендил|Бобов дол|Бобошево|Дупница|Кочериново|Невестино|Рила|Сапарева баня|Трекляно".split("|"),
    "ловеч": "Ловеч|Априлци|Летница|Луковит|Тетевен|Троян|Угърчин|Ябланица".split("|"),
    "монтана": "Монтана|Берковица|Бойчиновци|Брусарци|Вълчедръм|Вършец|Георги Дамяново|Лом|Медковец|Чипровци|Якимово".split("|"),
    "пазарджик": "Пазарджик|Батак|Белово|Брацигово|Велинград|Лесичово|Панагюрище|Пещера|Ракитово|Септември|Стрелча|Сърница".split("|"),
    "перник": "Перник|Брезник|Земен|Ковачевци|Радомир|Трън".split("|"),
    "плевен": "Плевен|Белене|Гулянци|Долна Митрополия|Долни Дъбник|Искър|Кнежа|Левски|Никопол|Пордим|Червен бряг".split("|"),
    "пловдив": "Пловдив|Асеновград|Брезово|Калояново|Карлово|Кричим|Куклен|Лъки|Марица|Перущица|Първомай|Раковски|Родопи|Садово|Сопот|Стамболийски|Съединение|Хисаря".split("|"),
    "разград": "Разград|Завет|Исперих|Кубрат|Лозница|Самуил|Цар Калоян".split("|"),
    "русе": "Русе|Борово|Бяла|Ветово|Две могили|Иваново|Сливо поле|Ценово".split("|"),
    "силистра": "Силистра|Алфатар|Главиница|Дулово|Кайнарджа|Ситово|Тутракан".split("|"),
    "сливен": "Сливен|Котел|Нова Загора|Твърдица".split("|"),
    "смолян": "Смолян|Баните|Борино|Девин|Доспат|Златоград|Мадан|Неделино|Рудозем|Чепеларе".split("|"),
    "софия": "София".split("|"),
    "софия област": "Антон|Божурище|Ботевград|Годеч|Горна Малина|Долна баня|Драгоман|Елин Пелин|Етрополе|Златица|Ихтиман|Копривщица|Костенец|Костинброд|Мирково|Пирдоп|Правец|Самоков|Своге|Сливница|Чавдар|Челопеч".split("|"),
    "стара загора": "Стара Загора|Братя Даскалови|Гурково|Гълъбово|Казанлък|Мъглиж|Николаево|Опан|Павел баня|Раднево|Чирпан".split("|"),
    "търговище": "Търговище|Антоново|Омуртаг|Опака|Попово".split("|"),
    "хасково": "Хасково|Димитровград|Ивайловград|Любимец|Маджарово|Минерални бани|Свиленград|Симеоновград|Стамболово|Тополовград|Харманли".split("|"),
    "шумен": "Шумен|Велики Преслав|Венец|Върбица|Каолиново|Каспичан|Никола Козлево|Нови пазар|Смядово|Хитрино".split("|"),
    "ямбол": "Ямбол|Болярово|Елхово|Стралджа|Тунджа".split("|"),
}
#: Names that are also rivers, mountains, people or common words: no evidence of another place.
AMBIGUOUS = "антон|баните|борино|борово|бяла|венец|грамада|долна баня|дружба|елена|завет|земен|иваново|искър|кула|левски|лъки|марица|мизия|минерални бани|ново село|опака|опан|павел баня|победа|раковски|рила|родопи|роман|руен|самуил|сапарева баня|септември|ситово|средец|стамболийски|съединение|тунджа|чавдар".split("|")
ALIASES = dict(pair.split("=") for pair in "софия-град=софия|софия град=софия|софийска=софия област|софия-област=софия област|великотърновска=велико търново|старозагорска=стара загора".split("|"))
TOWNS = [town for towns in PROVINCES.values() for town in towns]
