"""A small labelled URL table to train the URL filter from.

Written by hand from the kinds of pages that crawls usually drop (gambling, pills, adult pages,
link spam, advertising, loans, prizes) and keep (institutions, news, reference, shops, clubs,
personal pages).  Hosts and paths are invented; a larger table can be given in its place.
"""

# Hosts whose pages are unwanted in training data, and hosts whose pages are not.
BLOCKED_HOSTS = """
royalcasino.com casino-palace.net online-casino-guide.org luckyslots.com megaslots-casino.info
freespins.com roulette-tricks.net blackjack-bonus.com pokerbonus.org poker-freeroll.net
sportsbets.com bets4you.net bestbets.info bettingodds.org free-betting-tips.com livebets24.net
cheapmeds.com pills4less.net buy-cheap-pills.com dietpills.org online-pharmacy-discount.info
viagra-store.com generic-cialis.net weightloss-pills.org bestpills.biz cheap-viagra-pills.net
adultvideos.com adult-dating.net xxxtube.com hotxxx.org free-porn-movies.net porncams.info
escorts-directory.com sexchat.net nudecams.org adultfriend.biz webcam-girls.net
buybacklinks.com linkfarm.org cheap-backlinks.net seo-spam.info link-exchange.biz
adserver1.com ads-network.net clicktracker.org trackingpixel.net popup-ads.info adtrack.biz
banner-ads.com track-clicks.net ads.affiliate-links.org
winfreeprizes.com you-won-prize.net free-iphone-winner.org lotterywinner.info claim-your-prize.biz
paydayloan.com fast-cash-loans.net instant-credit-now.org cheap-credit-loans.info quickmoney.biz
replica-watches.com cheap-handbags-outlet.net fake-rolex.org crypto-doubler.biz earn-money-fast.info
"""
ALLOWED_HOSTS = """
citylibrary.org nationalmuseum.org universitypress.edu physics-department.edu ministry.gov
daily-herald.com eveningnews.net regionalpost.org radio-north.org weatherservice.gov
opendictionary.org encyclopedia-project.org linguistics-journal.org mathforum.net
bakery-martin.com bookshop-harbour.com bicycle-repair.net gardentools.com furniture-makers.org
chessclub.org rowing-society.org mountain-hut.net choir-festival.org birdwatchers.info
annasblog.net peter-writes.com familyrecipes.net travelswithmaps.com photo-diary.org
softwaredocs.org python-notes.net kernel-archive.org databases-explained.com compilers.info
hospital-trust.org health-advice.gov vet-clinic.net dentist-weber.com nursing-school.edu
bibliothek-stadt.de rathaus-online.de zeitung-heute.de verein-wandern.de universitaet-nord.de
mairie-village.fr journal-du-soir.fr bibliotheque-ville.fr ecole-primaire.fr musee-histoire.fr
ayuntamiento.es biblioteca-central.es periodico-sur.es instituto-lenguas.es museo-ciencia.es
stadsbibliotheek.nl comune-storico.it universidade-livre.pt kommune-info.dk skola-syd.se
railway-timetable.net airport-info.org shipping-register.org energy-statistics.gov census.gov
astronomy-club.org geology-maps.net river-trust.org forestry.info climate-records.org
courtreports.gov lawschool.edu parliament-archive.org elections.gov charity-register.org
theatre-season.com orchestra.org painters-guild.net filmreviews.com poetry-magazine.org
"""
# Pages are numbered and dated alike on both sides; only a few paths are typical of one.
SHARED_PATHS = """
/ /index.php /articles/2021/05/3817 /page/204 /item/95063.html /about /archive/7418/ /p/62.php
"""
BLOCKED_PATHS = "/bonus/claim /free-signup"
ALLOWED_PATHS = "/opening-hours /docs/history"
PREFIXES = ["", "www.", "news.", "shop."]
ENDINGS = ["com", "net", "org"]


def rows() -> list[tuple[str, str]]:
    """(url, verdict): every host as listed and with each ending, prefixes and paths in turn, so
    that neither ending nor prefix tells a label."""
    out = []
    for verdict, hosts, paths in (
        ("block", BLOCKED_HOSTS.split(), f"{SHARED_PATHS} {BLOCKED_PATHS}".split()),
        ("allow", ALLOWED_HOSTS.split(), f"{SHARED_PATHS} {ALLOWED_PATHS}".split()),
    ):
        for i, host in enumerate(hosts):
            name = host.rpartition(".")[0]
            for j, host in enumerate([host, *(f"{name}.{e}" for e in ENDINGS)]):
                prefix, path = PREFIXES[(i + j) % len(PREFIXES)], paths[(3 * i + j) % len(paths)]
                out.append((f"https://{prefix}{host}{path}", verdict))
    return out
