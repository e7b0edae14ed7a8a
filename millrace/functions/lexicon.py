"""Word and phrase lists used by the text presets."""

# English stop words, then the Italian additions.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself "
    "yourselves he him his himself she she's her hers herself it it's its itself they them their "
    "theirs themselves what which who whom this that that'll these those am is are was were be been "
    "being have has had having do does did doing a an the and but if or because as until while of at "
    "by for with about against between into through during before after above below to from up down "
    "in out on off over under again further then once here there when where why how all any both each "
    "few more most other some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn "
    "doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't needn "
    "needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

ITALIAN_STOP_WORDS = (
    "di da con fino generazion pollici per su il la le un uno una che e ma non si ci lo c'è cm"
).split()

# Units dropped as tokens of their own.
UNIT_WORDS = "gb tb mb ghz ddr ram ssd hz mhz".split()

# Words kept in their dictionary form instead of being stemmed.
PRESERVED_WORDS = (
    "laptop", "portatile", "office", "windows", "intel", "amd", "mouse", "computer", "home", "pc",
    "personal computer", "apple", "mac",
)

# Dictionary forms of preserved words that differ from the word.
PRESERVED_FORMS = {"windows": "window"}

# Adjacent tokens written as one term.
JOINED_PAIRS = {("m2", "ssd"): "m.2 ssd", ("dual", "band"): "dual-band"}

# Phrases kept as one token.
PHRASES = (
    "windows 11 pro", "windows 11 home", "windows 10 pro", "windows 10 home", "win 11 pro",
    "win 11 home", "win 10 pro", "win 10 home", "win 11", "win 10", "chrome os", "mac os",
    "linux ubuntu",
    "office 365", "office 2019", "office 19 pro", "office 2021", "office 2021 pro", "libre office",
    "google workspace", "365 office", "office 19", "office 21", "office 21 pro",
    "intel core i3", "core i3", "intel core i5", "core i5", "intel core i7", "core i7",
    "intel core i9", "core i9", "amd ryzen 3", "amd ryzen 5", "amd ryzen 7", "amd ryzen 9",
    "apple m1", "apple m2",
    "nvidia geforce gtx", "nvidia geforce rtx", "amd radeon rx", "intel iris xe", "nvidia quadro",
    "integrated graphics", "discrete graphics",
    "full hd", "4k uhd", "8k uhd", "oled display", "retina display", "anti glare", "infinity edge",
    "touch screen", "refresh rate",
    "ddr4 ram", "ddr5 ram", "lpddr4x", "lpddr5x", "m.2 ssd", "nvme ssd", "sata ssd", "hard drive",
    "hdd", "1tb ssd", "2tb ssd", "512gb ssd", "256gb ssd", "16gb ram", "32gb ram", "64gb ram",
    "128gb ssd", "64gb emmc", "expandable storage",
    "dual band wifi", "wifi 6", "wifi 5", "bluetooth 5.1", "bluetooth 5.2", "ethernet port",
    "gigabit ethernet", "usb c", "usb 3.0", "hdmi port", "thunderbolt 3", "thunderbolt 4", "wi-fi",
    "battery life", "fast charging", "usb c charging", "power adapter", "watt power supply",
    "battery backup", "removable battery", "long battery life",
    "lightweight design", "slim bezel", "aluminum body", "carbon fiber", "spill resistant keyboard",
    "backlit keyboard", "fingerprint reader", "face recognition", "secure boot", "fanless design",
    "portable design",
    "dolby audio", "stereo speakers", "dual speakers", "noise cancellation", "built in webcam",
    "hd webcam", "privacy shutter", "dual microphone",
    "wireless mouse", "keyboard cover", "stylus pen", "usb hub", "hdmi cable", "screen protector",
    "carry case", "laptop stand",
    "gaming laptop", "workstation laptop", "business laptop", "2 in 1 laptop", "detachable keyboard",
    "convertible laptop", "all in one desktop", "tower pc", "mini pc", "high performance",
    "energy efficient", "overclocked", "pre installed software",
    "mini computer", "mini desktop", "pc portatile", "all in one", "pronto all'uso",
)
