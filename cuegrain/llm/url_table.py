"""Hosts and paths by label, beside the words in url_filter: the part of the labelled table that no rule makes.

Ordinary sites include names that share pieces with unwanted words. None is a site of the given tables.
"""

UNWANTED_SITES = """
casino-royal-bonus.com/free-spins pokernight-cash.net/deposit slotmachine-heaven.biz/games bet-now-live.com/football roulettewheel-win.info betting-tips-vip.com lottery-results-win.net/claim
bingo-bonus-club.com/join blackjack-online-money.com sportsbook-odds.biz/live-odds jackpotcity-play.com gamblers-den.biz casino.games-win.net 777-slots.com/spin
viagra-generic-store.com/buy cialis-no-rx.net buy-tramadol.biz/order pharmacy-online-rx.com/cheap pillshop24.com weightloss-pills.biz steroids-shop.net rx-meds-discount.com xanax-overnight.net/order slimfast-detox.info
porn-videos.com/watch freeporn-hd.net xxxtube.biz/videos sex-chat-live.com nudegirls.net/pics hardcore-adult.com hentai-porn.info camgirls-live.com/room milf-dating.net hookup-tonight.com/join escort-service.biz sexcams.net erotic-singles.com
payday-loans-fast.com/apply cash-advance-now.biz bad-credit-loan.net/apply-now easy-money-online.com get-rich-quick.biz bitcoin-profit-system.com/signup crypto-millionaire.net/invest forex-robot-income.com binary-options-win.com doubleyourmoney.info
buy-links-seo.com cheap-seo-traffic.net link-farm-directory.biz bulk-email-blast.com/order article-spinner.net web-traffic-bot.com guestpost-backlinks.com buyfollowers-likes.com/buy
ads-tracker.com/click adserver-cdn.net/banner popads-network.com/pop clicktrack-affiliate.com/redirect pixel-tracking.net/px banner-exchange.biz trk-clicks.com/go affiliate-offers.net/cpa ad-doubleclicks.com/adserv
replica-rolex.biz fake-designer-bags.com cheap-jerseys-outlet.net knockoff-shoes.com keygen-serial.com/download crackedsoftware.net warez-downloads.biz torrent-movies-free.com nulled-scripts.net pirate-downloads.com/full free-crack-serial.info
win-free-iphone.com/claim survey-rewards.net/offer giftcard-winner.biz you-are-a-winner.com/prize claim-bonus-now.info verify-account-login.com/signin secure-bank-update.net/login appleid-verify.info account-suspended-alert.com/verify paypai-secure.com/login
miracle-cure.biz free-offer-today.com lose-weight-fast.net
"""

ORDINARY_SITES = """
drugs-and-medicines.nhs-guide.org/leaflets pharmacology.edu/lectures medicinesafety.gov/alerts addiction-support.org/help dietitians.org/advice healthydiets.edu/nutrition
essexcounty.gov/planning wessexarchaeology.org/digs unisex-hairdresser.com sextant-sailing.org/navigation adultlearning.edu/courses young-adult-fiction.org/reviews
betsyross-house.org/visit betony-herbs.com betterbuses.org/timetable alphabeta-software.com/docs tibet-studies.edu betterworld-books.org
trackside-photos.com/steam railtracks.org/lines racetrack-history.org eyetracking-lab.edu/papers soundtracks.org/films
advertising-history.org/posters morningadvertiser.com/features adventure-playground.org adviser-magazine.com/pensions admin-guide.org/linux address-finder.gov
campcamille.org/summer camberwell-arts.org webcamerarepair.com/prices camp-and-hike.net
credits-and-titles.org/film accreditation.gov/schools student-loans-advice.gov/repay library-loans.org/renew cashmere-knits.com cashew-farmers.org/harvest investigations.org/reports investor-relations.com/annual-report profitablefarming.org earnest-drama.org/plays
linked-data.org/spec linkoping.se/en golf-links.org/course seoul-travel.org/guide seowon-heritage.org farmhouse-kitchen.com bulkhead-lighting.com directory.council.gov trafficreport.gov/roads
bannerman-castle.org/history pixelart.org/tutorials clickspring-clocks.com clackmannan.gov popcorn-cinema.com/listings
fakenham-racecourse.org serialnovels.org/chapter crackling-pork.com/recipes torrentriver-walks.org outletstream-fishing.com cheapest-days-to-fly.travel
winterthur.org/museum windows-and-doors.com windsor-castle.org winchester-cathedral.org/visit prizeforfiction.org/shortlist freelance-writers.org/rates freestyle-swimming.org/clubs freethinkers-society.org offering-churches.org survey-of-london.org/volumes geologicalsurvey.gov/maps claims-court.gov/forms verification-methods.edu/papers miraculous-medal.org bonusarmy-history.org
pillarbox-collectors.org caterpillar-nursery.com slotted-screws.com tableware-shop.com tablemountain.org/hike pokerwork-crafts.org lotharingia.edu lottevanbeek.nl
hotelrivoli.com/rooms hotpot-recipes.com/beef shotput-coaching.org nudibranch-reef.org/species singlespeed-bikes.com datingrocks-geology.edu carbon-dating-lab.edu spinningwheel-crafts.org
moneymuseum.org/coins bitcoin-research.edu/papers downloads.linuxproject.org/iso login.university.edu/portal account.library.org/renew secure.council.gov/pay shop.bookstore.com/cart order.bakery.com/bread buy-local-produce.org play.chessclub.org live.orchestra.org/concert
"""
