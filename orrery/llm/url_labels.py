"""The small labelled table of urls from which the URL filter is trained: invented hosts and paths, one line each, by verdict."""

from __future__ import annotations

BLOCK = """
http://cheap-meds-24.example.biz/buy/viagra-online?ref=77
https://www.luckyjackpot.example/slots/free-spins/bonus
http://casino-royal777.example.net/poker/tournament/register
https://xxx-tube.example.cc/videos/adult/hot
http://payday-loans-now.example.info/apply/instant-cash
https://replica-watches.example.shop/rolex/discount/sale
http://win-iphone.example.click/prize/claim.php?id=3
https://torrent-bay.example.se/download/movie-hdrip-crack
http://free-cracks.example.ru/keygen/photoshop-serial
https://sexchat.example.tv/live/cams/nude
http://seo-backlinks.example.top/buy-links/cheap-pagerank
https://clickbait-daily.example.co/you-wont-believe/celebrity-shock
http://diet-pills.example.biz/lose-weight-fast/miracle
https://bet365x.example.win/betting/odds/live-bets
http://spam-farm.example.xyz/auto-generated/keyword-list/0913
https://account-verify.example.support/login/secure/update-paypal
http://bank-alert.example.work/signin/confirm-password
https://hot-singles.example.date/near-you/dating/join
http://download-free-mp3.example.link/songs/full-album-zip
https://warez.example.to/appz/nulled/scripts
http://cheapviagra.example.in/pharmacy/no-prescription
https://online-poker.example.bet/texas-holdem/bonus-code
http://make-money-fast.example.guru/work-from-home/earn-5000
https://crypto-doubler.example.io/invest/double-your-coins
http://fake-id.example.pw/order/driver-licence
https://escort-city.example.xxx/girls/gallery
http://hack-account.example.club/instagram-hacker/free
https://malware-host.example.space/setup.exe
http://phish.example.online/apple-id/unlock
https://gamble24.example.casino/roulette/play-now
http://pornhubz.example.me/categories/amateur
https://buy-followers.example.social/instagram/likes/cheap
http://essay-writers.example.pro/buy-essay/cheap-papers
https://miracle-cure.example.health/detox/secret-remedy
http://lottery-winner.example.org.example.vip/claim/prize
https://slotmachine.example.fun/jackpot/mega-win
http://adult-toys.example.store/sex/discount
https://loan-shark.example.cash/bad-credit/approved
http://pills4u.example.rx/cialis/generic/buy
https://keygen-world.example.cx/crack/windows-activator
http://get-rich.example.biz/forex-robot/guaranteed-profit
https://spamlinks.example.pl/tag/cheap-shoes-outlet
http://doorway.example.cf/best-cheap-handbags-replica-2019
https://nude-celebs.example.tk/leaked/photos
http://scam-coins.example.ml/airdrop/claim-now
https://bonus-hunter.example.ga/no-deposit-bonus/list
http://xvideo-free.example.gq/watch/hd-porn
https://rxmeds.example.su/order/tramadol-overnight
http://link-exchange.example.date/directory/add-url/free
https://cam-girls.example.vg/webcam/private-show
http://pirate-stream.example.ws/watch-free/full-movie
https://ransom-tools.example.onion.example.ly/kit
http://hacked-accounts.example.cm/netflix/premium-free
https://surveys-for-cash.example.buzz/earn/gift-card
http://fat-burner.example.loan/keto-pills/trial
https://sportsbook.example.ag/parlay/bet-now
http://auto-blog.example.stream/spun-content/page-331
https://cheap-tickets-scam.example.trade/winner/click-here
http://penis-pills.example.review/enlarge/buy
https://blackhat.example.party/cloaking/redirect.php?u=9
"""

ALLOW = """
https://www.citylibrary.example.org/catalogue/new-books
http://museum.example.edu/exhibitions/bronze-age
https://news.example.com/world/election-results
http://weather.example.net/forecast/week/north-coast
https://journal.example.ac/articles/vol12/soil-chemistry
http://gardening.example.org/guides/pruning-roses
https://recipes.example.com/soups/lentil-and-carrot
http://physics.example.edu/lectures/mechanics/week-3
https://docs.example.dev/reference/array-functions
http://parliament.example.gov/debates/transcripts/march
https://railways.example.co.uk/timetables/winter
http://health.example.gov/advice/vaccination-children
https://forum.woodworkers.example.net/threads/oak-table-finish
http://school.example.sch/calendar/term-dates
https://encyclopedia.example.org/wiki/Glacier
http://university.example.edu/departments/linguistics/courses
https://blog.example.com/travel/walking-the-harbour-villages
http://theatre.example.org/season/hamlet/cast
https://statistics.example.gov/tables/population-by-age
http://archive.example.org/newspapers/1911/issue-42
https://birdwatch.example.org/species/barn-owl
http://castle.example.com/visit/opening-hours
https://maps.example.org/trails/mountain-ridge
http://music.example.edu/scores/string-quartet
https://bakery.example.com/menu/sourdough
http://history.example.net/essays/printing-press
https://open-source.example.dev/projects/parser/issues/88
http://council.example.gov.uk/planning/applications/2021
https://science.example.org/news/deep-sea-vents
http://observatory.example.edu/planets/jupiter/moons
https://law.example.org/statutes/chapter-7
http://cooking.example.net/techniques/kneading-dough
https://marathon.example.org/results/2018/women
http://hospital.example.org/departments/cardiology/contact
https://bookshop.example.com/reviews/the-lantern-maker
http://painting.example.org/gallery/water-colours
https://tutorials.example.dev/sql/window-functions
http://farmers.example.coop/market/orchard-fruit
https://language.example.edu/grammar/irregular-verbs
http://engineering.example.org/bridges/suspension
https://archaeology.example.org/digs/river-valley
http://festival.example.com/programme/folk-music
https://ocean.example.gov/tides/harbour-station
http://radio.example.org/podcasts/morning-review
https://astronomy.example.net/calendar/meteor-shower
http://teacher.example.org/worksheets/fractions
https://parks.example.gov/trees/maple
http://village.example.org/parish/newsletter-june
https://chess.example.org/openings/queens-gambit
http://cinema.example.com/listings/friday
https://choir.example.org/concerts/winter
http://biology.example.edu/notes/cell-membrane
https://photography.example.net/how-to/long-exposure
http://consumer.example.org/tests/washing-machines
https://bicycle.example.org/repair/brake-cable
http://philosophy.example.edu/entries/scepticism
https://kitchen.example.com/stories/grandmothers-bread
http://geology.example.gov/maps/bedrock
https://poetry.example.org/poems/the-weaver
http://transport.example.gov/roads/closures
"""


def labelled() -> list[tuple[str, float]]:
    """(url, bad)."""
    return [(u, bad) for bad, text in ((1.0, BLOCK), (0.0, ALLOW)) for u in text.split()]
